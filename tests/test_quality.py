from decimal import Decimal

from pyspark.sql import functions as F

from helpers import rows
from tiffinlake.operators import quality as dq
from tiffinlake.plans import entities as en


def test_null_counts_include_nan_only_for_floats(spark):
    df = spark.createDataFrame([(1, "a", float("nan")), (None, "NaN", None), (3, None, 1.0)], "a int, b string, c double")
    assert rows(dq.null_counts(df)) == [("a", 1), ("b", 1), ("c", 2)]
    assert rows(dq.null_counts(df, ["b"])) == [("b", 1)]


def test_primary_key(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (2, None)], "a int, b int")
    assert rows(dq.primary_key(df, "a")) == [("a", 4, 2, 1, False)]
    assert rows(dq.primary_key(df, ["a", "b"])) == [("a,b", 4, 2, 2, True)]


def test_foreign_key_and_examples(spark):
    df = spark.createDataFrame([(1,), (1,), (7,), (8,), (9,), (None,), (None,)], "fk int")
    ref = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    assert rows(dq.foreign_key(df, "fk", ref, "id")) == [("fk", 4, 2, 3)]
    assert rows(dq.orphan_examples(df, "fk", ref, "id", 2)) == [(7, 1), (8, 1)]


def test_histogram_closed_last_bin_empty_bins_and_constant(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.99,), (10.0,), (None,)], "x double")
    got = dq.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r.row_count for r in got] == [2, 0, 0, 0, 2]
    assert (got[0].bin_min, got[-1].bin_max) == (0.0, 10.0)
    constant = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r.row_count for r in dq.histogram(constant, "x", 3).orderBy("bin").collect()] == [2, 0, 0]
    assert sum(r.row_count for r in dq.histogram(df.filter("false"), "x", 3).collect()) == 0


def test_summary_and_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (3, None), (3, None), (5, "b")], "x int, y string")
    s = dq.summary(df, "x").collect()[0]
    assert (s.value_count, s.mean, s.min, s.max, round(s.stddev, 6)) == (5, 2.6, 1, 5, 1.67332)
    assert rows(dq.duplicates(df)) == [(1, "a", 2), (3, None, 2)]
    assert len(dq.duplicate_examples(df, ["x"], 1).collect()) == 1


def test_report_and_verdict(spark):
    good = spark.createDataFrame([(1, 10), (2, 20)], "id int, fk int")
    ref = spark.createDataFrame([(10,), (20,)], "k int")
    report = dq.quality_report(good, pk="id", fks={"fk": (ref, "k")})
    assert rows(dq.verdict(report)) == [(5, 0, False)]
    bad = good.unionByName(spark.createDataFrame([(2, 20), (None, 30)], "id int, fk int"))
    report = dq.quality_report(bad, pk="id", fks={"fk": (ref, "k")})
    assert rows(report.filter("NOT ok"), "check_name", "target", "value") == [
        ("duplicates", "id,fk", 1), ("foreign_key", "fk", 1), ("not_null", "id", 1), ("primary_key", "id", 1),
    ]
    assert rows(dq.verdict(report)) == [(5, 4, True)]


def test_declared_constraints(spark):
    menu = spark.createDataFrame([(1, 401, "x", Decimal("1.00")), (1, 402, None, None)],
                                 "menu_id bigint, restaurant_id_fk bigint, item_name string, price decimal(10,2)")
    restaurants = spark.createDataFrame([(401,)], "restaurant_id bigint")
    report = dq.check_constraints(menu, en.MENU, {"restaurant": restaurants})
    assert rows(report.filter("NOT ok"), "check_name", "target") == [
        ("duplicates", "menu_id"), ("foreign_key", "restaurant_id_fk"), ("not_null", "item_name"),
        ("not_null", "price"), ("primary_key", "menu_id"),
    ]


def test_reconcile(spark):
    bronze = spark.createDataFrame([(Decimal("1.50"),), (Decimal("2.50"),)], "amount decimal(10,2)")
    silver = bronze.filter("amount > 2")
    got = rows(dq.reconcile({"bronze": bronze, "silver": silver}, ["amount"]), "layer", "metric", "value", "ok")
    D = Decimal
    assert got == [
        ("bronze", "amount", D("4.00"), True), ("bronze", "row_count", D("2.00"), True),
        ("silver", "amount", D("2.50"), False), ("silver", "row_count", D("1.00"), False),
    ]


def test_missing_entities(spark):
    loads = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02"), ("a", "2024-01-01")], "entity string, _execution_date string")
    assert rows(dq.missing_entities(spark, loads, ["a", "b", "c"], "2024-01-01"), "entity") == [("b",), ("c",)]


def test_layer_counts(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-01",), ("2024-01-02",)], "_execution_date string")
    assert [(r.layer, str(r.batch_date), r.row_count) for r in
            dq.layer_counts({"bronze": df, "silver": df.limit(0)}).orderBy("batch_date").collect()] == [
        ("bronze", "2024-01-01", 2), ("bronze", "2024-01-02", 1),
    ]


def test_anomalies(spark):
    kpi = spark.createDataFrame([(i, 100.0) for i in range(20)] + [(99, 1000.0)], "day int, revenue double")
    flagged = dq.anomalies(kpi, "revenue")
    assert rows(flagged.filter("is_anomaly"), "day") == [(99,)]
    same = dq.anomalies(kpi.filter(F.col("day") < 20), "revenue")
    assert same.filter("z_score <> 0 OR is_anomaly").count() == 0

"""Large dimensions: what is moved, kept and freed on the way to the fact, and what their versions cost."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tiffinlake.operators import planning
from tiffinlake.operators.timeline import as_of_join, most_versions
from tiffinlake.plans import entities as en
from tiffinlake.plans import star
from tiffinlake.queries import QUERIES
from tiffinlake.sources.marketplace import Marketplace

DIR = "/root/testdata/sf0.001"


@pytest.fixture()
def nothing_small(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df) -> list:
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("query", ["fact_order_item", "fact_order_item_inner", "fact_as_of_dims"])
def test_shuffles_of_large_dimensions_are_gone_when_items_meet_orders(spark, nothing_small, query):
    fact = QUERIES[query](spark, DIR)
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan_of(fact))) == {"order_id_fk", "header_order_id"}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows_of(fact) == rows_of(QUERIES[query](spark, DIR))


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("versions", [1, 3])
def test_versions_of_large_dimensions_by_key(spark, how, versions):
    """Versions that begin late, end early, or are never in force; orders at their borders and without a date."""
    rng = random.Random(versions)
    day = lambda n: None if n is None else f"2023-01-{n:02d} 00:00:00"
    n = 12
    orders = [(i, i % n, i % n, day(rng.choice([None, *range(1, 20)]))) for i in range(40)] + [(3, 3, 3, day(4)), (None, 1, 1, day(5))]
    orders = spark.createDataFrame(orders, "order_id long, customer_id_fk long, restaurant_id_fk long, order_date string")
    orders = orders.withColumn("order_date", F.col("order_date").cast("timestamp"))
    delivery = orders.where("order_id <> 7").select(
        F.col("order_id").alias("order_id_fk"), F.col("order_date").alias("modified_date"), F.col("order_id").alias("delivery_id"),
        F.col("restaurant_id_fk").alias("delivery_agent_id_fk"), F.col("customer_id_fk").alias("customer_address_id_fk"),
        F.lit("Delivered").alias("delivery_status"), F.lit("1").alias("estimated_time"),
    )
    items = [(i, rng.choice([None, *range(44)]), rng.choice([None, *range(n + 2)])) for i in range(150)]
    items = spark.createDataFrame(items, "order_item_id long, order_id_fk long, menu_id_fk long")
    items = items.select("*", *[F.col("order_item_id").cast("decimal(10,2)").alias(c) for c in star.MEASURES])

    def dim(entity, **links):
        made = []
        for k in range(n):
            starts = sorted(rng.sample(range(1, 4 if versions == 1 else 15), versions))
            made += [(f"{entity.name}{k}{s}", k, day(s), day(rng.choice([None, None, s, s + 5, s + 9]))) for s in starts]
        made.append(("without key", None, day(1), None))
        rows = spark.createDataFrame(made, f"{entity.surrogate} string, {entity.keys[0]} long, a string, b string")
        return rows.select(
            entity.surrogate, entity.keys[0], *[F.col(entity.keys[0]).alias(c) for c in links],
            F.col("a").cast("timestamp").alias(entity.start), F.col("b").cast("timestamp").alias(entity.end), F.lit(True).alias(entity.flag),
        ).localCheckpoint()

    dims = {
        "location": dim(en.LOCATION), "restaurant": dim(en.RESTAURANT, location_id_fk=1), "customer": dim(en.CUSTOMER),
        "customeraddress": dim(en.CUSTOMER_ADDRESS, customer_id_fk=1), "menu": dim(en.MENU), "deliveryagent": dim(en.DELIVERY_AGENT),
        "date": star.date_dim(spark, "2023-01-01", "2023-01-31"),
    }
    build = lambda staged: rows_of(star.build_order_item_fact(items, orders, delivery, dims, how, "as_of", staged=staged))
    want = build(False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert build(False) == build(True) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(want) >= 150 if how == "left" else want  # order 3 came twice


def test_few_versions_of_a_large_dimension_need_no_time_line(spark, nothing_small):
    rng = random.Random(0)
    rows = [(rng.randrange(20), s := rng.randrange(50), rng.choice([None, s, s + 2, s + 30]), rng.randrange(3)) for _ in range(60)]
    dim = spark.createDataFrame(rows, "k long, a int, b int, v int")
    dim = dim.select("k", "v", F.timestamp_seconds("a").alias("eff_start_date"), F.timestamp_seconds("b").alias("eff_end_date"))
    fact = spark.range(2000).select("id", F.when(F.col("id") % 9 > 0, F.col("id") % 23).alias("k"), F.timestamp_seconds(F.col("id") % 60).alias("at"))
    assert 1 < most_versions(dim, ["k"], "eff_start_date", "eff_end_date") <= 8
    got = as_of_join(fact, dim, "k", "at", columns=["v"])
    assert "FileScan" not in plan_of(got) and "Broadcast" not in plan_of(got)
    assert rows_of(got) == rows_of(as_of_join(fact, dim, "k", "at", columns=["v"], small_dim=False))


def test_few_rows_are_broadcast_where_that_saves_a_large_shuffle(spark, monkeypatch):
    few = spark.range(1000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("hk"))
    assert planning.is_worth_broadcasting(few, spark.range(1_000_000))
    assert not planning.is_worth_broadcasting(few, spark.range(10_000))
    monkeypatch.setattr(planning, "BROADCAST_BYTES", 1000 * (24 + 64) - 1)
    assert not planning.is_worth_broadcasting(few, spark.range(1_000_000))
    monkeypatch.undo()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not planning.is_worth_broadcasting(few, spark.range(1_000_000))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_what_a_stored_table_was_built_with_is_freed(spark):
    held = Marketplace(spark, DIR)
    seen = []
    held.stored("freed-probe", lambda: seen.append(spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")) or spark.range(3))
    assert seen == ["true"]

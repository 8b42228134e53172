"""Jobs that read and rewrite only what a batch touches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import CHANGED, CSV, drop_file, rows
from tiffinlake.plans import entities as en
from tiffinlake.plans import jobs, kpi, kpi_refresh, star
from tiffinlake.sources import files, tables


def names(spark, path):
    """The data files of a partitioned table, by partition."""
    found = {}
    for folder in files.child_names(spark, path):
        if "=" in folder:
            found[folder] = sorted(n for n in files.child_names(spark, f"{path}/{folder}") if n.endswith(".parquet"))
    return found


class Shop:
    """A warehouse with master data, and days of sales as landing files."""

    def __init__(self, spark, path):
        self.spark, self.path, self.lake = spark, path, jobs.Lake(str(path / "lake"))
        for name in [e.name for e in en.DIMENSIONS]:
            self.deliver("2023-01-01", name, CSV[name][:1])
            jobs.build_dimension(spark, self.lake, en.ENTITIES[name], "2023-01-01")
        jobs.tables.write_snapshot(star.date_dim(spark, "2023-01-01", "2023-12-31"), self.lake.dimension("date"))

    def deliver(self, day, name, lines):
        entity = en.ENTITIES[name]
        folder = drop_file(self.path / day / name, entity, lines)
        jobs.ingest(self.spark, self.lake, entity, folder, day)
        jobs.refine(self.spark, self.lake, entity, day)

    def sales(self, day, orders=(), items=(), deliveries=()):
        for name, lines in (("orders", orders), ("order_item", items), ("delivery", deliveries)):
            self.deliver(day, name, lines)
        return jobs.build_fact(self.spark, self.lake, day)

    @property
    def fact(self):
        return tables.read_table(self.spark, self.lake.fact)


def order(key, at):
    return f"{key},7,5,{at},10,Completed,Cash,{at},{at}"


def item(key, order_key, at, price="10"):
    return f"{key},{order_key},50,1,{price},{price},{at},{at}"


def delivery(key, order_key, at, status="Delivered", changed=None):
    return f"{key},{order_key},3,{status},35 minutes,70,{at},{at},{changed or at}"


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    shop = Shop(spark, tmp_path_factory.mktemp("shop"))
    january, march, may = "2023-01-10T10:00:00", "2023-03-10T10:00:00", "2023-05-10T10:00:00"
    shop.first = shop.sales(
        "2023-05-11", [order(i, at) for i, at in ((1, january), (2, march), (3_000_000, may))],
        [item(11, 1, january), item(21, 2, march), item(22, 2, may, "5"), item(31, 3_000_000, may)],
        [delivery(1, 1, january), delivery(2, 2, march, "Pending"), delivery(3, 3_000_000, may)],
    )
    return shop


def test_a_late_delivery_reads_and_rewrites_the_months_of_its_order(shop, spark, monkeypatch):
    assert shop.first == [202301, 202303, 202305]
    before = rows(shop.fact)
    assert len(before) == 4
    lake = shop.lake
    kept = {t: names(spark, p) for t, p in (("fact", lake.fact), ("items", lake.silver(en.ORDER_ITEM)))}
    seen = []
    real = tables.one_of
    monkeypatch.setattr(tables, "one_of", lambda c, v: seen.append((c, list(v))) or real(c, v))
    june = "2023-06-01T10:00:00"
    months = shop.sales("2023-06-01", deliveries=[delivery(2, 2, "2023-03-10T10:00:00", "Delivered", june)])
    assert months == [202303, 202305], "the order's items lie in two months, its delivery in March"
    assert (jobs.RANGE, [0]) in seen and (jobs.RANGE, [2]) not in seen
    after = names(spark, lake.fact)
    assert after["_created_month=202301"] == kept["fact"]["_created_month=202301"]
    assert after["_created_month=202305"] != kept["fact"]["_created_month=202305"]
    assert names(spark, lake.silver(en.ORDER_ITEM)) == kept["items"], "no item came, none was rewritten"
    assert {r.delivery_status for r in shop.fact.collect()} == {"Delivered"}
    changed = [c for c in shop.fact.columns if c not in ("delivery_status", "_execution_date")]
    places = [shop.fact.columns.index(c) for c in changed]
    assert rows(shop.fact, *changed) == sorted((tuple(r[i] for i in places) for r in before), key=repr)


def test_scans_of_silver_are_pruned(shop, spark):
    orders = spark.createDataFrame([(2,)], "order_id long")
    months = jobs.touched_months(spark, shop.lake, en.ORDER_ITEM, orders)
    assert months == [202303, 202305]
    scan = jobs.read_silver(spark, shop.lake, en.ORDER_ITEM).filter(tables.one_of(jobs.MONTH, months))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_created_month" in plan


def test_tables_without_a_log_get_one(shop, spark):
    files.delete(spark, shop.lake.changes(en.ORDER_ITEM))
    before = rows(shop.fact.drop("_execution_date"))
    months = shop.sales("2023-06-02", items=[item(12, 1, "2023-01-10T10:00:00", "7")])
    assert months == [202301]
    assert len(rows(shop.fact)) == len(before) + 1
    assert jobs.touched_months(spark, shop.lake, en.ORDER_ITEM, spark.createDataFrame([(2,)], "order_id long")) == [202303, 202305]


def test_late_dimension_days_in_any_order(spark, tmp_path):
    versions = {}
    for name, days in (("forth", (0, 1, 2)), ("back", (2, 0, 1, 1))):
        lake = jobs.Lake(str(tmp_path / name))
        lines = [CSV["customer"][0], CSV["customer"][1], CSV["customer"][1].replace("Apple", "OTP").replace(CHANGED, "2023-04-01T00:00:00")]
        for n, i in enumerate(days):
            folder = drop_file(tmp_path / f"{name}{n}", en.CUSTOMER, [lines[i]])
            jobs.ingest(spark, lake, en.CUSTOMER, folder, f"2023-05-0{i + 1}")
            jobs.refine(spark, lake, en.CUSTOMER, f"2023-05-0{i + 1}")
            jobs.build_dimension(spark, lake, en.CUSTOMER, f"2023-05-0{i + 1}", late=True)
        dim = tables.read_snapshot(spark, lake.dimension("customer"))
        versions[name] = rows(dim, "customer_hk", "login_by_using", en.CUSTOMER.start, en.CUSTOMER.end, "is_current")
    assert versions["forth"] == versions["back"] and len(versions["forth"]) == 3


def fact_rows(rng, n, months):
    """Facts whose orders may lie in several storage months, on several days and at several restaurants."""
    out = []
    for i in range(n):
        day = datetime(2023, rng.choice(months), rng.randint(1, 28)) + timedelta(days=rng.randint(0, 9))
        out.append((i, rng.randint(1, n // 3) * 40_000 % 100_003, f"r{rng.randint(1, 3)}", f"{rng.randint(1, 999)}.25",
                    rng.choice(["Delivered", "Pending"]), day.date(), 202300 + rng.choice(months), rng.random() < 0.1))
    return out


def write_fact(spark, lake, data, mode="overwrite"):
    fact = spark.createDataFrame(
        data, "order_item_id bigint, order_id bigint, restaurant_dim_key string, s string, delivery_status string, d date, _created_month int, is_deleted boolean"
    )
    fact = fact.withColumn("subtotal", F.col("s").cast("decimal(10,2)")).withColumn("order_date_dim_key", F.sha2(F.col("d").cast("string"), 256))
    fact = fact.drop("s", "d")
    if mode == "overwrite":
        tables.write_table(fact, lake.fact, mode, [jobs.MONTH])
    else:
        tables.replace_partitions(spark, lake.fact, fact, fact.schema[jobs.MONTH])


def same_reports(spark, lake):
    fact, days = tables.read_table(spark, lake.fact), tables.read_snapshot(spark, lake.dimension("date"))
    restaurants = tables.read_snapshot(spark, lake.dimension("restaurant"))
    for by in kpi.PERIODS:
        want = kpi.revenue_kpi(fact, days, by, restaurants)
        got = kpi_refresh.report(spark, lake, by).select(*want.columns)
        assert rows(got) == rows(want), by


def test_reports_follow_changed_months(spark, tmp_path):
    rng = random.Random(1)
    lake = jobs.Lake(str(tmp_path))
    tables.write_snapshot(star.date_dim(spark, "2023-01-01", "2023-12-31"), lake.dimension("date"))
    names_of = spark.createDataFrame([("r1", "one"), ("r2", "two"), ("r3", "one")], "restaurant_hk string, name string")
    tables.write_snapshot(names_of, lake.dimension("restaurant"))
    write_fact(spark, lake, fact_rows(rng, 300, [1, 2, 5, 8]))
    assert kpi_refresh.refresh(spark, lake)
    same_reports(spark, lake)
    kept = names(spark, kpi_refresh._path(lake, "days"))
    new = [(*r[:6], 202302, r[7]) for r in fact_rows(rng, 60, [2])]  # February's facts are others now
    write_fact(spark, lake, new, "replace")
    reached = kpi_refresh.refresh(spark, lake, [202302])
    same_reports(spark, lake)
    untouched = {f"_order_month={m}" for m in range(202301, 202313)} - {f"_order_month={m}" for m in reached}
    after = names(spark, kpi_refresh._path(lake, "days"))
    assert all(after.get(m) == kept.get(m) for m in untouched)
    write_fact(spark, lake, [(*r[:7], True) for r in fact_rows(rng, 20, [5]) if r[6] == 202305], "replace")  # all deleted
    kpi_refresh.refresh(spark, lake, [202305])
    same_reports(spark, lake)
    assert kpi_refresh.refresh(spark, lake, [202305]) is not None
    same_reports(spark, lake)
    monthly = kpi_refresh.report(spark, lake, "month", months=kpi_refresh.months_of(2023))
    assert rows(monthly) == rows(kpi_refresh.report(spark, lake, "month").select(*monthly.columns))
    february = kpi_refresh.report(spark, lake, "restaurant", months=[202302])
    every = kpi_refresh.report(spark, lake, "restaurant").filter("month = 2").select(*february.columns)
    assert rows(kpi.top_restaurants(february, 2023, 2)) == rows(kpi.top_restaurants(every, 2023, 2)) != []
    for df in (monthly, february):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [_order_month" in plan, "months are partitions of the scan"

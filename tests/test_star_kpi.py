from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import CHANGED, CSV, DELIVERED, ORDERED, drop_file, rows, ts
from tiffinlake.operators.scd2 import apply_scd2
from tiffinlake.plans import entities as en
from tiffinlake.plans import jobs, kpi, star
from tiffinlake.plans.silver import to_silver
from tiffinlake.sources import tables
from tiffinlake.sources.raw import read_raw


@pytest.fixture()
def example(spark, tmp_path):
    """Typed tables and dimensions of the sample rows; ``version`` 1 is after the updates."""

    def typed(name, lines):
        entity = en.ENTITIES[name]
        folder = drop_file(tmp_path / f"{name}-{abs(hash(tuple(lines)))}", entity, lines)
        return to_silver(read_raw(spark, folder, entity.raw_columns, "2023-01-15"), entity)

    def dims(updated):
        out = {"date": star.date_dim(spark, "2023-01-01", "2023-03-31")}
        for entity in en.DIMENSIONS:
            dim = None
            for line in CSV[entity.name][: 2 if updated else 1]:
                dim = apply_scd2(
                    typed(entity.name, [line]), dim, list(entity.keys), entity.surrogate, list(entity.tracking),
                    F.col(entity.modified), entity.start, entity.end, entity.flag,
                )
            out[entity.name] = dim
        return out

    return typed, dims


def test_date_dim_attributes(spark):
    days = star.date_dim(spark, "2023-01-01", "2023-12-31")
    assert days.count() == 365
    row = days.filter(F.col("calendar_date") == F.lit(date(2023, 1, 15))).collect()[0]
    assert (row.year, row.quarter, row.month, row.week, row.day_of_year, row.day_of_week, row.day_of_the_month, row.day_name) == (
        2023, 1, 1, 2, 15, 1, 15, "Sunday",
    )


def test_date_dim_spans_orders_inclusively(spark):
    orders = spark.createDataFrame([(ts("2023-01-05T10:00:00"),), (ts("2023-01-07T23:59:59"),)], "order_date timestamp")
    assert rows(star.date_dim_of(orders), "calendar_date") == [(date(2023, 1, d),) for d in (5, 6, 7)]
    assert star.date_dim_of(orders, end="2023-01-10").count() == 6
    assert star.date_dim_of(orders.filter("false")).count() == 0


def test_fact_example(example):
    typed, dims = example
    fact = star.build_order_item_fact(
        typed("order_item", CSV["order_item"]), typed("orders", CSV["orders"]), typed("delivery", CSV["delivery"]), dims(False)
    )
    row = fact.collect()[0]
    assert (row.order_item_id, row.order_id, row.quantity, row.price, row.subtotal) == (
        9001, 900, Decimal("3.00"), Decimal("89.50"), Decimal("268.50"),
    )
    assert (row.delivery_status, row.estimated_time) == ("Delivered", "35 minutes")
    assert all(row[k] is not None for k in star.DIM_KEYS)
    assert fact.filter(star.unresolved()).count() == 0
    assert tuple(star.fact_metrics(fact).collect()[0]) == (1, 0, Decimal("268.50"), 1, Decimal("268.50"))


def test_lookup_as_of_and_current(example):
    """The order points at the versions then in force, or at today's."""
    typed, dims = example
    parts = [typed(n, CSV[n]) for n in ("order_item", "orders", "delivery")]
    all_dims = dims(True)
    as_of = star.build_order_item_fact(*parts, all_dims, lookup="as_of").collect()[0]
    current = star.build_order_item_fact(*parts, all_dims).collect()[0]
    pairs = {
        "customer_dim_key": en.CUSTOMER, "customer_address_dim_key": en.CUSTOMER_ADDRESS,
        "restaurant_dim_key": en.RESTAURANT, "restaurant_location_dim_key": en.LOCATION,
        "menu_dim_key": en.MENU, "delivery_agent_dim_key": en.DELIVERY_AGENT,
    }
    for key, entity in pairs.items():
        old, new = [r[entity.surrogate] for r in all_dims[entity.name].orderBy(entity.start).collect()]
        assert (as_of[key], current[key]) == (old, new)


def test_missing_parents_left_and_inner(example, spark):
    typed, dims = example
    items = typed("order_item", CSV["order_item"] + [f"9002,9999,777,1,10,10,{ORDERED},{ORDERED}"])
    orders, delivery = typed("orders", CSV["orders"]), typed("delivery", CSV["delivery"])
    left = star.build_order_item_fact(items, orders, delivery, dims(False))
    assert rows(left.filter(star.unresolved()), "order_item_id", "customer_dim_key") == [(9002, None)]
    inner = star.build_order_item_fact(items, orders, delivery, dims(False), how="inner")
    assert rows(inner, "order_item_id") == [(9001,)]


def test_delivery_without_its_order_still_counts(example):
    """Deliveries attach to the item's order id even when the order itself is late."""
    typed, dims = example
    orders = typed("orders", CSV["orders"]).filter("false")
    row = star.build_order_item_fact(
        typed("order_item", CSV["order_item"]), orders, typed("delivery", CSV["delivery"]), dims(False)
    ).collect()[0]
    assert row.delivery_status == "Delivered" and row.delivery_agent_dim_key and row.customer_dim_key is None


def test_late_dimension_fills_the_fact(example):
    """The customer arrives a day after the order: the fact waits with a NULL key, then gets it."""
    typed, dims = example
    parts = [typed(n, CSV[n]) for n in ("order_item", "orders", "delivery")]
    known = dims(False)
    early = star.build_order_item_fact(*parts, known | {"customer": known["customer"].filter("false")})
    assert rows(early.filter(star.unresolved()), "order_item_id") == [(9001,)]
    filled = star.upsert_fact(early, star.build_order_item_fact(*parts, known))
    assert filled.filter(star.unresolved()).count() == 0 and filled.count() == 1


def test_several_deliveries_do_not_fan_out(example):
    typed, dims = example
    late = f"91,900,3,Refunded,35 minutes,70,{DELIVERED},{ORDERED},{CHANGED}"
    fact = star.build_order_item_fact(
        typed("order_item", CSV["order_item"]), typed("orders", CSV["orders"]), typed("delivery", CSV["delivery"] + [late]), dims(False)
    )
    assert rows(fact, "order_item_id", "delivery_status") == [(9001, "Refunded")]


@pytest.fixture()
def small_fact(spark):
    days = star.date_dim(spark, "2022-01-01", "2024-12-31")
    data = [
        # item, order, restaurant, subtotal, status, day
        (1, 10, "r1", "100.00", "Delivered", date(2022, 1, 1)),
        (2, 10, "r1", "50.01", "Delivered", date(2022, 1, 1)),
        (3, 11, "r2", "70.00", "Pending", date(2022, 1, 2)),
        (4, 12, "r2", "30.00", "Delivered", date(2024, 5, 6)),
        (5, 13, "r1", "30.00", "Delivered", date(2024, 5, 6)),
    ]
    fact = spark.createDataFrame(data, "order_item_id bigint, order_id bigint, restaurant_dim_key string, s string, delivery_status string, d date")
    fact = fact.select("*", F.col("s").cast("decimal(10,2)").alias("subtotal"), F.sha2(F.col("d").cast("string"), 256).alias("order_date_dim_key"))
    names = spark.createDataFrame([("r1", "Zaika"), ("r2", "Amber")], "restaurant_hk string, name string")
    return fact, days, names


def test_kpis(small_fact):
    fact, days, names = small_fact
    yearly = kpi.revenue_kpi(fact, days, "year")
    D = Decimal
    assert rows(yearly) == [
        (2022, D("150.01"), 1, D("150.01"), D("75.01"), D("100.00")),
        (2024, D("60.00"), 2, D("30.00"), D("30.00"), D("30.00")),
    ]
    assert rows(kpi.revenue_kpi(fact, days, "day_name", status=None), "year", "day_name", "total_orders") == [
        (2022, "Saturday", 1), (2022, "Sunday", 1), (2024, "Monday", 2),
    ]
    assert rows(kpi.kpi_totals(yearly)) == [(D("210.01"), 3, D("100.00"))]
    # 2023 has no row, so 2024 has nothing to compare with.
    assert all(r.total_revenue_diff is None for r in kpi.yoy_delta(yearly).collect())
    assert rows(kpi.kpi_run_metrics(yearly)) == [(2, 2024, D("60.00"))]
    monthly = kpi.revenue_kpi(fact, days, "restaurant", names)
    assert rows(monthly, "month", "delivery_status", "restaurant_name", "total_revenue") == sorted(
        [(1, "Delivered", "Zaika", D("150.01")), (1, "Pending", "Amber", D("70.00")),
         (5, "Delivered", "Amber", D("30.00")), (5, "Delivered", "Zaika", D("30.00"))], key=repr)
    top = kpi.top_restaurants(monthly, 2024, 5, 1).collect()
    assert [r.restaurant_name for r in top] == ["Amber"], "equal revenue: the name decides"
    assert rows(kpi.months_available(monthly, 2024)) == [(5,)]
    assert rows(kpi.latest_period(monthly)) == [(2024, 5)]
    labelled = kpi.monthly_revenue(kpi.revenue_kpi(fact, days, "month"), 2022).collect()
    assert [(r.month_label, r.total_revenue) for r in labelled] == [("Jan", D("150"))]


def test_kpis_ignore_deleted_facts(small_fact):
    fact, days, _ = small_fact
    flagged = fact.withColumn("is_deleted", F.col("order_id") == 10)
    assert rows(kpi.revenue_kpi(flagged, days, "year"), "year", "total_orders") == [(2024, 2)]


def test_warehouse_over_two_days(spark, tmp_path):
    """Landing files to KPIs: first loads, updates, a rerun, a late delivery and a delete."""
    lake = jobs.Lake(str(tmp_path / "lake"))
    dimensional = [e.name for e in en.DIMENSIONS]

    def day(execution_date, files):
        for name, lines in files.items():
            entity = en.ENTITIES[name]
            folder = drop_file(tmp_path / execution_date / name, entity, lines)
            jobs.ingest(spark, lake, entity, folder, execution_date, batch_ts=f"{execution_date} 01:00:00")
            jobs.refine(spark, lake, entity, execution_date, batch_ts=f"{execution_date} 02:00:00")
            if entity.surrogate:
                jobs.build_dimension(spark, lake, entity, execution_date)

    everything = list(en.ENTITIES.values())
    assert jobs.gate(spark, lake, everything, "2023-01-16").count() == 9
    first = {n: CSV[n][:1] for n in en.ENTITIES}
    first["location"] = first["location"] + ["junk", "13|Madurai|Tamil Nadu"]
    day("2023-01-16", first)
    assert jobs.gate(spark, lake, everything, "2023-01-16").count() == 0
    assert jobs.quarantined(spark, lake, en.LOCATION, "2023-01-16").count() == 2
    assert jobs.bronze_batch(spark, lake, en.LOCATION, "2023-01-16").count() == 1
    jobs.build_date_dimension(spark, lake, end="2023-12-31")
    jobs.build_fact(spark, lake, "2023-01-16")
    before = rows(tables.read_table(spark, lake.fact))
    jobs.build_fact(spark, lake, "2023-01-16")
    assert rows(tables.read_table(spark, lake.fact)) == before, "a rerun changes nothing"

    late = {"delivery": [CSV["delivery"][0].replace("Delivered", "Refunded").replace(DELIVERED, CHANGED)]}
    day("2023-03-06", {n: CSV[n][1:2] for n in dimensional} | late)
    for entity in en.DIMENSIONS:
        dim = tables.read_snapshot(spark, lake.dimension(entity.name))
        assert dim.count() == 2 and dim.filter(F.col(entity.flag)).count() == 1
    jobs.build_fact(spark, lake, "2023-03-06", lookup="as_of")
    fact = tables.read_table(spark, lake.fact)
    assert rows(fact, "order_item_id", "delivery_status") == [(9001, "Refunded")]
    assert rows(fact, *star.DIM_KEYS) == [tuple(before[0][3:10])], "the order keeps the versions of its day"

    jobs.publish_kpis(spark, lake)
    assert spark.table("revenue_by_restaurant").select("delivery_status", "restaurant_name").collect() == [
        ("Refunded", "Dosa Corner")
    ]
    assert spark.table("revenue_by_year").count() == 0, "nothing delivered any more"

    gone = spark.createDataFrame([(7, "moved away", ts("2023-03-21T09:00:00"))],
                                 "customer_id bigint, delete_reason string, delete_timestamp timestamp")
    jobs.build_dimension(spark, lake, en.CUSTOMER, "2023-03-06", deletes=gone)
    assert tables.read_snapshot(spark, lake.dimension("customer")).filter("is_current").count() == 0

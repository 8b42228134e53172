"""Revenue KPIs over the fact, and the dashboard queries on top of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed_values import DELIVERED
from ..functions.rules import month_label
from ..operators.deletes import active_only

# Grouping columns per granularity, as (date dimension column, output name).
PERIODS = {
    "year": [("year", "year")],
    "month": [("year", "year"), ("month", "month")],
    "day": [("year", "year"), ("month", "month"), ("day_of_the_month", "day")],
    "day_name": [("year", "year"), ("month", "month"), ("day_name", "day_name")],
    "restaurant": [("year", "year"), ("month", "month")],
}
METRICS = [
    "total_revenue",
    "total_orders",
    "avg_revenue_per_order",
    "avg_revenue_per_item",
    "max_order_value",
]


def revenue_metrics() -> list:
    """The five metrics of every view. ``max_order_value`` is the largest line, as its users know it."""
    revenue = F.sum("subtotal")
    n_orders, n_items = F.count_distinct("order_id"), F.count("order_item_id")
    return [
        revenue.alias("total_revenue"),
        n_orders.alias("total_orders"),
        F.round(revenue / n_orders, 2).alias("avg_revenue_per_order"),
        F.round(revenue / n_items, 2).alias("avg_revenue_per_item"),
        F.max("subtotal").alias("max_order_value"),
    ]


def revenue_kpi(
    fact: DataFrame,
    date_dim: DataFrame,
    by: str,
    restaurant_dim: DataFrame | None = None,
    status: str | None = DELIVERED,
) -> DataFrame:
    """KPIs by "year", "month", "day", "day_name" or "restaurant".

    ``status`` filters on the delivery status, None counts all. By restaurant the status is a group
    of its own and not filtered. Logically deleted facts never count.
    """
    periods = PERIODS[by]
    facts = active_only(fact)
    if by != "restaurant" and status is not None:
        facts = facts.filter(F.col("delivery_status") == status)
    days = date_dim.select("date_dim_hk", *[c for c, _ in periods]).alias("d")
    facts = facts.select(
        "order_id", "order_item_id", "subtotal", "delivery_status", "order_date_dim_key", "restaurant_dim_key"
    ).alias("f")
    joined = facts.join(days, F.expr("f.order_date_dim_key = d.date_dim_hk"), "inner")
    groups = [F.col(c).alias(name) for c, name in periods]
    if by == "restaurant":
        if restaurant_dim is None:
            raise ValueError("KPIs by restaurant need the restaurant dimension")
        names = restaurant_dim.select("restaurant_hk", F.col("name").alias("restaurant_name")).alias("r")
        joined = joined.join(names, F.expr("f.restaurant_dim_key = r.restaurant_hk"), "inner")
        groups += [F.col("delivery_status"), F.col("restaurant_name")]
    return joined.groupBy(*groups).agg(*revenue_metrics())


def kpi_totals(yearly: DataFrame) -> DataFrame:
    """All-years totals."""
    return yearly.agg(
        F.sum("total_revenue").alias("total_revenue"),
        F.sum("total_orders").alias("total_orders"),
        F.max("max_order_value").alias("max_order_value"),
    )


def yoy_delta(yearly: DataFrame) -> DataFrame:
    """Each year's metrics and their difference to the year before; NULL where that year has no row."""
    previous = yearly.select((F.col("year") + 1).alias("year"), *METRICS).alias("p")
    return (
        yearly.alias("y")
        .join(previous, F.expr("y.year = p.year"), "left")
        .select(
            F.col("y.year"),
            *[F.col(f"y.{m}") for m in METRICS],
            *[(F.col(f"y.{m}") - F.col(f"p.{m}")).alias(f"{m}_diff") for m in METRICS],
        )
    )


def top_restaurants(monthly: DataFrame, year: int, month: int, n: int = 10) -> DataFrame:
    """The report's best restaurants of a month by revenue; the name breaks ties."""
    return (
        monthly.filter((F.col("year") == year) & (F.col("month") == month))
        .orderBy(F.desc("total_revenue"), "restaurant_name", "delivery_status")
        .limit(n)
        .select("restaurant_name", *METRICS)
    )


def label_months(df: DataFrame) -> DataFrame:
    """Adds the month's label and shows revenue as a whole number."""
    return df.withColumns(
        {
            "month_label": month_label(F.col("month")),
            "total_revenue": F.col("total_revenue").cast("decimal(38,0)"),
        }
    )


def monthly_revenue(monthly: DataFrame, year: int) -> DataFrame:
    """Labelled revenue per month of a year, in calendar order."""
    rows = monthly.filter(F.col("year") == year).select("month", "total_revenue")
    return label_months(rows).orderBy("month")


def months_available(monthly: DataFrame, year: int) -> DataFrame:
    return monthly.filter(F.col("year") == year).select("month").distinct()


def latest_period(monthly: DataFrame) -> DataFrame:
    """The latest year with data and its latest month: the report's default selection."""
    latest = F.max(F.struct("year", "month"))
    return monthly.agg(latest.alias("p")).select("p.year", "p.month")


def kpi_run_metrics(yearly: DataFrame) -> DataFrame:
    return yearly.agg(
        F.count(F.lit(1)).alias("num_years"),
        F.max("year").alias("latest_year"),
        F.max_by("total_revenue", "year").alias("latest_revenue"),
    )

"""Gold: the date dimension and the order-item fact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.keys import as_timestamp, hash_key, packed_key, unpacked_key
from ..operators.dedup import latest_per_key
from ..operators.planning import is_light, is_small, is_worth_broadcasting
from ..operators.timeline import as_of_join, in_force, most_versions
from ..operators.upsert import upsert
from ..sources import tables
from . import entities as en

FACT_KEYS = ["order_item_id", "order_id"]
DIM_KEYS = [
    "customer_dim_key",
    "customer_address_dim_key",
    "restaurant_dim_key",
    "restaurant_location_dim_key",
    "menu_dim_key",
    "delivery_agent_dim_key",
    "order_date_dim_key",
]
MEASURES = ["quantity", "price", "subtotal"]


def calendar_attributes(days: DataFrame) -> DataFrame:
    """Date key and attributes of each ``calendar_date``: ISO week, Sunday is day 1."""
    d = F.col("calendar_date")
    return days.select(
        F.sha2(d.cast("string"), 256).alias("date_dim_hk"),
        d,
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.weekofyear(d).alias("week"),
        F.dayofyear(d).alias("day_of_year"),
        F.dayofweek(d).alias("day_of_week"),
        F.dayofmonth(d).alias("day_of_the_month"),
        F.date_format(d, "EEEE").alias("day_name"),
    )


def date_dim(spark: SparkSession, start, end) -> DataFrame:
    """Every day from ``start`` to ``end``, both included."""
    bounds = spark.range(1).select(F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("b"))
    return calendar_attributes(bounds.select(F.explode(F.sequence("a", "b")).alias("calendar_date")))


def date_dim_of(orders: DataFrame, column: str = "order_date", end=None) -> DataFrame:
    """Every day from the earliest order to ``end``, by default the latest order."""
    day = F.to_date(column)
    last = F.max(day) if end is None else F.lit(end).cast("date")
    bounds = orders.agg(F.min(day).alias("a"), last.alias("b")).filter(F.col("a").isNotNull())
    return calendar_attributes(bounds.select(F.explode(F.sequence("a", "b")).alias("calendar_date")))


def _versions(dim: DataFrame, on: Mapping[str, str], spec: en.Entity, output: str, extra: Mapping[str, str], lookup: str) -> DataFrame:
    """What a lookup reads of a dimension: natural key, surrogate key, packed for the way, and ``extra`` columns."""
    wanted = [packed_key(spec.surrogate).alias(output), *[F.col(c).alias(a) for c, a in extra.items()]]
    if lookup == "as_of":
        return dim.select(*[F.col(d) for d in on.values() if d not in extra], *wanted, spec.start, spec.end)
    if lookup != "current":
        raise ValueError("lookup is 'current' or 'as_of'")
    return dim.filter(F.col(spec.flag)).select(*[F.col(d).alias(f"__{d}") for d in on.values()], *wanted)


def _attach(
    df: DataFrame,
    versions: DataFrame,
    on: Mapping[str, str],
    spec: en.Entity,
    columns: Sequence[str],
    lookup: str,
    ts: str,
    how: str,
) -> DataFrame:
    """Adds ``columns`` of a dimension's versions by natural key."""
    if lookup == "as_of":
        return as_of_join(df, versions, dict(on), ts, columns=columns, start=spec.start, end=spec.end, how=how)
    condition = None
    for left, right in on.items():
        one = F.col(f"l.{left}") == F.col(f"r.__{right}")
        condition = one if condition is None else condition & one
    return df.alias("l").join(versions.alias("r"), condition, how).select("l.*", *[F.col(f"r.{a}") for a in columns])


def _too_large(versions: DataFrame, keys: Sequence[str]) -> bool:
    """Whether Spark would take the versions for small by their files though they are not.

    A reader may take the keys alone, so it is these whose estimate counts.
    """
    return is_small(versions.select(*keys)) and not is_light(versions)


def _settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored, and what it shuffled freed; kept from a broadcast if it is small as files only."""
    with tables.scratch(df.sparkSession):
        kept = tables.stored(df, name, keep=1, codec=tables.CODEC)
    return kept if is_light(kept) else kept.hint("merge")


# Dimensions that depend on the order alone: name, entity, columns of the order to its key, output, extra columns.
_OF_ORDER = [
    ("customer", en.CUSTOMER, {"customer_id_fk": "customer_id"}, "customer_dim_key", {}),
    (
        "customeraddress", en.CUSTOMER_ADDRESS, {"customer_id_fk": "customer_id_fk", "customer_address_id_fk": "address_id"},
        "customer_address_dim_key", {},
    ),
    ("restaurant", en.RESTAURANT, {"restaurant_id_fk": "restaurant_id"}, "restaurant_dim_key", {"location_id_fk": "__location_id"}),
    ("location", en.LOCATION, {"__location_id": "location_id"}, "restaurant_location_dim_key", {}),
    ("deliveryagent", en.DELIVERY_AGENT, {"delivery_agent_id_fk": "delivery_agent_id"}, "delivery_agent_dim_key", {}),
]
_MENU = ("menu", en.MENU, {"menu_id_fk": "menu_id"}, "menu_dim_key", {})


_ORDER_COLUMNS = ["order_id", "customer_id_fk", "restaurant_id_fk", "order_date"]
_FROM, _UNTIL = "__menu_from", "__menu_until"


def _with_only_version(items: DataFrame, versions: DataFrame, how: str) -> DataFrame:
    """Items with the menu's key and validity, for menus of one version each."""
    _, spec, on, output, _ = _MENU
    ((left, right),) = on.items()
    once = in_force(versions, [right], spec.start, spec.end)
    start, end = F.col(spec.start).cast("timestamp").alias(_FROM), F.col(spec.end).cast("timestamp").alias(_UNTIL)
    once = once.select(F.col(right).alias(f"__{right}"), output, start, end)
    return (
        items.alias("l").join(once.alias("r"), F.col(f"l.{left}") == F.col(f"r.__{right}"), how)
        .select("l.*", f"r.{output}", f"r.{_FROM}", f"r.{_UNTIL}")
    )


def _while_valid(fact: DataFrame, at: str, how: str) -> DataFrame:
    """What ``_with_only_version`` attached, where the order falls into its validity."""
    when = F.col(at).cast("timestamp")
    valid = (when >= F.col(_FROM)) & (F.col(_UNTIL).isNull() | (when < F.col(_UNTIL)))
    if how == "inner":
        return fact.filter(valid)
    return fact.withColumn(_MENU[3], F.when(valid, F.col(_MENU[3])))


def _order_headers(orders: DataFrame, delivery: DataFrame, how: str) -> DataFrame:
    """One row per order with its latest delivery: what the dimensions are looked up by, no keys yet."""
    latest = latest_per_key(
        delivery.select(
            "order_id_fk", "modified_date", "delivery_id", "delivery_agent_id_fk", "customer_address_id_fk",
            "delivery_status", "estimated_time",
        ),
        "order_id_fk",
        ["modified_date", "delivery_id"],
    )
    return (
        orders.select(*_ORDER_COLUMNS).alias("o")
        .join(latest.alias("v"), F.expr("o.order_id = v.order_id_fk"), "inner" if how == "inner" else "full_outer")
        .select(
            F.coalesce("o.order_id", "v.order_id_fk").alias("header_order_id"),
            "o.customer_id_fk",
            "o.restaurant_id_fk",
            "o.order_date",
            "v.delivery_agent_id_fk",
            "v.customer_address_id_fk",
            "v.delivery_status",
            "v.estimated_time",
        )
    )


def _attach_day(df: DataFrame, days: DataFrame, how: str) -> DataFrame:
    return (
        df.alias("l")
        .join(days.alias("r"), F.to_date("l.order_date") == F.col("r.calendar_date"), how)
        .select("l.*", "r.order_date_dim_key")
    )


def build_order_item_fact(
    order_items: DataFrame,
    orders: DataFrame,
    delivery: DataFrame,
    dims: Mapping[str, DataFrame],
    how: str = "left",
    lookup: str = "current",
    batch_ts=None,
    execution_date: str | None = None,
    carry: Sequence[str] = (),
    staged: bool = False,
) -> DataFrame:
    """The fact at order-item grain; measures come from the order item.

    Columns of the order items named in ``carry`` are passed on. ``staged`` is for readers of the whole
    fact, keys and all: what large dimensions were joined to is stored before items meet their orders, and
    its shuffle files are freed. Rows of one key lie together then, so its digest takes hardly any room.

    ``how``: "left" keeps items whose orders, deliveries or dimensions are missing (NULL keys),
    "inner" drops them. ``lookup``: "current" dimension versions, or those valid at order time.
    Of several deliveries of an order the latest counts, so the grain never fans out.

    All dimensions but the menu depend on the order only. Large ones are resolved per order, before the
    items join, and the menu per item before it has any other key, so no join moves rows with many keys;
    on the way a key takes half its length (``packed_key``). What Spark broadcasts waits until items have
    met their orders: such keys don't move at all. Current versions that are small as files only, many times
    larger as rows, are kept from a broadcast; those few against their facts, as measured, are broadcast beyond
    Spark's limit, up to a fixed size. Adaptive execution splits skewed order, customer or restaurant keys.
    """
    at = "order_date"
    headers = _order_headers(orders, delivery, how)
    items = order_items.select("order_item_id", "order_id_fk", "menu_id_fk", *MEASURES, *carry)

    looked_up, small = {}, set()
    for name, spec, on, output, extra in [*_OF_ORDER, _MENU]:
        versions = _versions(dims[name], on, spec, output, extra, lookup)
        current = lookup == "current"
        too_large = _too_large(versions, [f"__{d}" if current else d for d in on.values()])
        if not too_large and is_small(versions):
            small.add(name)
        elif is_worth_broadcasting(versions, items if name == _MENU[0] else orders.select(*_ORDER_COLUMNS)):
            versions = F.broadcast(versions) if current else versions
            small.add(name)
        elif too_large and current:
            versions = versions.hint("merge")
        looked_up[name] = versions

    def resolved(df: DataFrame, name: str, spec: en.Entity, on: Mapping[str, str], output: str, extra: Mapping[str, str]) -> DataFrame:
        return _attach(df, looked_up[name], on, spec, [output, *extra.values()], lookup, at, how)

    waiting, missing = [], set()
    for one in _OF_ORDER:
        if one[0] in small or missing & set(one[2]):
            waiting.append(one)
            missing |= set(one[4].values())
        else:
            headers = resolved(headers, *one)
    days = dims["date"].select("calendar_date", packed_key("date_dim_hk").alias("order_date_dim_key"))
    day_waits = is_small(days)
    if not day_waits:
        headers = _attach_day(headers, days, how)
    if staged and len(waiting) < len(_OF_ORDER):
        headers = _settled(headers, "order-headers")
    if _MENU[0] in small:
        waiting.append(_MENU)
    elif lookup == "current":
        items = resolved(items, *_MENU)
    elif most_versions(looked_up[_MENU[0]], list(_MENU[2].values()), en.MENU.start, en.MENU.end) <= 1:
        # It is found by key alone; whether it was valid yet, or still, shows once the order is there.
        items = _with_only_version(items, looked_up[_MENU[0]], how)
    else:  # the menu's version depends on when the order was placed
        placed = orders.select(F.col("order_id").alias("header_order_id"), at).distinct().alias("p")
        dated = items.alias("i").join(placed, F.expr("i.order_id_fk = p.header_order_id"), how).select("i.*", f"p.{at}")
        items = resolved(dated, *_MENU).withColumnRenamed(at, "__placed")
    if staged and _MENU not in waiting:
        items = _settled(items, "menu-items")
    same_order = F.col("i.order_id_fk") == F.col("h.header_order_id")
    if "__placed" in items.columns:  # an order number that came twice may have two times
        same_order = same_order & F.col("i.__placed").eqNullSafe(F.col(f"h.{at}"))
    fact = items.alias("i").join(headers.alias("h"), same_order, how).select("i.*", "h.*")
    if _FROM in fact.columns:
        fact = _while_valid(fact, at, how)
    for one in waiting:
        fact = resolved(fact, *one)
    if day_waits:
        fact = _attach_day(fact, days, how)
    columns = [
        hash_key("order_item_id", "order_id_fk").alias("order_item_fact_sk"),
        F.col("order_item_id"),
        F.col("order_id_fk").alias("order_id"),
        *[unpacked_key(c).alias(c) for c in DIM_KEYS],
        *[F.col(c) for c in MEASURES],
        F.col("delivery_status"),
        F.col("estimated_time"),
        *[F.col(c) for c in carry],
    ]
    if batch_ts is not None:
        columns.append(as_timestamp(batch_ts).alias("_processing_time"))
    if execution_date is not None:
        columns.append(F.lit(execution_date).cast("date").alias("_execution_date"))
    return fact.select(*columns)


def upsert_fact(
    target: DataFrame | None, source: DataFrame, batch_ts=None, keep: Sequence[str] = ()
) -> DataFrame:
    """Keyed upsert, so loading a batch again changes nothing and late dimensions fill NULL keys.

    Columns in ``keep`` stay as first stored.
    """
    updated = [c for c in source.columns if c not in FACT_KEYS and c not in keep]
    return upsert(target, source, FACT_KEYS, updated, batch_ts=batch_ts)


def unresolved(required: tuple[str, ...] = ("customer_dim_key", "restaurant_dim_key", "menu_dim_key")) -> Column:
    """True for a fact row that arrived before one of the dimensions it needs."""
    condition = F.lit(False)
    for c in required:
        condition = condition | F.col(c).isNull()
    return condition


def fact_metrics(fact: DataFrame) -> DataFrame:
    """Load metrics in one pass: rows, unresolved rows, revenue, orders, average order value."""
    revenue, n_orders = F.sum("subtotal"), F.count_distinct("order_id")
    return fact.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(unresolved()).alias("null_dim_count"),
        revenue.alias("total_revenue"),
        n_orders.alias("order_count"),
        F.round(revenue / F.nullif(n_orders, F.lit(0)), 2).alias("avg_order_value"),
    )

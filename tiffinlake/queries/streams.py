"""Consume-once feeds, run to completion over files derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.scd2 import apply_changes_scd2
from ..plans import entities as en
from ..plans.jobs import MONTH, month_number
from ..plans.silver import to_silver
from ..sources import files, raw, tables
from ..sources.marketplace import DIM_TRACKING, FIRST_LOAD, SECOND_LOAD
from ..streaming import changes
from ..streaming.feeds import append_feed, stream_append, stream_upsert as run_stream_upsert
from . import scd, sql as q  # noqa: F401  (scd registers SQL used here)
from .registry import ORACLES, query

EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value"]


@query(
    "stream_append_feed",
    """SELECT event_type, count(*) AS row_count, count(DISTINCT event_id) AS events FROM events GROUP BY 1""",
)
def stream_append_feed(m):
    """Two runs over a landing folder: the second finds nothing new and adds no rows."""
    landing, sink = files.shared_folder(m.spark, "landing"), files.shared_folder(m.spark, "stage")
    checkpoint = files.shared_folder(m.spark, "checkpoint")
    m.table("events").select(*[F.col(c).cast("string") for c in EVENT_COLUMNS]).write.option(
        "header", "true"
    ).csv(landing)
    for _ in range(2):
        feed = append_feed(m.spark, landing, raw.text_schema(EVENT_COLUMNS))
        stream_append(feed, sink, checkpoint).awaitTermination()
    return (
        m.spark.read.parquet(sink)
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("event_id").alias("events"))
    )


_UPSERTED = """SELECT o_orderkey AS order_id, o_custkey AS customer_id_fk,
       CASE WHEN o_orderstatus = 'F' THEN 'Delivered' ELSE 'Placed' END AS status,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS modified_dt FROM orders"""


def _orders_twice(m, partition_by: str | None = None) -> str:
    """Orders arrive all as placed, then the finished ones as delivered; returns where the table is."""
    landing, target = files.shared_folder(m.spark, "orders-landing"), files.shared_folder(m.spark, "orders")
    checkpoint = files.shared_folder(m.spark, "orders-checkpoint")
    spec = en.ORDERS

    def drop(rows, status: str, days: int) -> None:
        stamped = F.date_format(F.date_add("o_orderdate", days), "yyyy-MM-dd'T'HH:mm:ss")
        values = {
            "orderid": F.col("o_orderkey").cast("string"),
            "customerid": F.col("o_custkey").cast("string"),
            "orderdate": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"),
            "status": F.lit(status),
            "modifieddate": stamped,
        }
        columns = [values.get(c, F.lit(None).cast("string")).alias(c) for c in spec.raw_columns]
        rows.select(*columns).write.mode("append").option("header", "true").csv(landing)

    def typed(batch):
        return to_silver(batch, spec).withColumn(MONTH, month_number("order_date"))

    def run() -> None:
        run_stream_upsert(
            m.spark, landing, raw.text_schema(spec.raw_columns), target, "order_id", checkpoint,
            order_by="modified_dt", transform=typed, partition_by=partition_by,
        ).awaitTermination()

    orders = m.table("orders")
    drop(orders, "Placed", 0)
    run()
    drop(orders.filter(F.col("o_orderstatus") == "F"), "Delivered", 1)
    run()
    return target


@query("stream_upsert", _UPSERTED)
def stream_upsert(m):
    """The later state of an order wins; every micro-batch is a version of a snapshot table."""
    rows = tables.read_snapshot(m.spark, _orders_twice(m))
    return rows.select("order_id", "customer_id_fk", "status", "modified_dt")


@query(
    "stream_upsert_partitioned",
    _UPSERTED.replace(" FROM orders", ", CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS order_month FROM orders"),
)
def stream_upsert_partitioned(m):
    """The same into a table by month of the order: a micro-batch rewrites the months it affects."""
    rows = tables.read_table(m.spark, _orders_twice(m, MONTH), merge_schema=False)
    return rows.select("order_id", "customer_id_fk", "status", "modified_dt", F.col(MONTH).alias("order_month"))


def _feed(before: str, after: str, versions: str) -> str:
    """The net changes between two states, as SQL over their names."""
    changed = "b.preferences <> a.preferences OR b.name <> a.name"
    return f"""SELECT b.*, 'DELETE' AS action, a.k IS NOT NULL AS is_update, {versions}
  FROM {before} b LEFT JOIN (SELECT customer_id AS k, name, preferences FROM {after}) a ON a.k = b.customer_id
  WHERE a.k IS NULL OR {changed}
  UNION ALL SELECT a.*, 'INSERT', b.k IS NOT NULL, {versions}
  FROM {after} a LEFT JOIN (SELECT customer_id AS k, name, preferences FROM {before}) b ON a.customer_id = b.k
  WHERE b.k IS NULL OR {changed}"""


def _versions(first: str, last: str) -> str:
    return f"CAST({first} AS BIGINT) AS from_version, CAST({last} AS BIGINT) AS to_version"


@query(
    "stream_change_feed",
    f"""WITH {q.BEFORE_AFTER}, final AS (SELECT * FROM before WHERE preferences <> 'BUILDING')
        SELECT *, 'INSERT' AS action, false AS is_update, {_versions("NULL", "0")} FROM before
        UNION ALL {_feed("before", "after", _versions("0", "1"))}
        UNION ALL {_feed("after", "final", _versions("1", "3"))}""",
)
def stream_change_feed(m):
    """Changes of the customer table between the versions a consumer saw, each logged once.

    It runs after version 0, again without news, after version 1, after versions 2 and 3, whose changes
    are netted, and last with its checkpoint lost, which repeats nothing.
    """
    source, log = files.shared_folder(m.spark, "customer-versions"), files.shared_folder(m.spark, "customer-changes")
    checkpoint = files.shared_folder(m.spark, "changes-checkpoint")

    def run(at: str = checkpoint) -> None:
        changes.consume_changes(m.spark, source, log, "customer_id", at, changes.log_changes).awaitTermination()

    changes.publish(m.customers(), source)
    run()
    run()
    changes.publish(m.customers_next(), source)
    run()
    changes.publish(m.customers(), source)
    changes.publish(m.customers().filter("preferences <> 'BUILDING'"), source)
    run()
    run(files.shared_folder(m.spark, "changes-checkpoint"))
    return changes.read_log(m.spark, log)


@query("stream_scd2_from_changes", ORACLES["scd2_from_cdc"])
def stream_scd2_from_changes(m):
    """A dimension that consumes the changes of its source table: first load, then inserts, updates and deletes."""
    source, target = files.shared_folder(m.spark, "customer-versions"), files.shared_folder(m.spark, "customer-dim")
    checkpoint = files.shared_folder(m.spark, "dim-checkpoint")
    times = [FIRST_LOAD, SECOND_LOAD]

    def apply(dim, feed, _, after):
        return apply_changes_scd2(dim, feed, "customer_id", "customer_hk", DIM_TRACKING["customer"], times[after])

    for state in (m.customers(), m.customers_next()):
        changes.publish(state, source)
        changes.consume_changes(m.spark, source, target, "customer_id", checkpoint, apply).awaitTermination()
    return tables.read_snapshot(m.spark, target)

"""Slowly changing dimensions, change feeds and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import change_hash, hash_key
from ..operators import scd2
from ..operators.change_feed import change_feed, version_diff as diff_versions
from ..operators.dedup import latest_per_key as pick_latest
from ..operators.splice import splice_scd2
from ..operators.timeline import scd2_history as replay
from ..sources.marketplace import DIM_TRACKING, FIRST_LOAD, SECOND_LOAD
from ..sources.tables import stored
from . import sql as q
from .registry import ORACLES, query

KEY, HK, TRACKING = "customer_id", "customer_hk", DIM_TRACKING["customer"]
REACTIVATED = "2003-01-01 00:00:00"

_HK1 = q.hk("customer_id", "name", "preferences", q.instant(FIRST_LOAD))
_HK2 = q.hk("customer_id", "name", "preferences", q.instant(SECOND_LOAD))
_HK3 = q.hk("customer_id", "name", "preferences", q.instant(REACTIVATED))
_OPEN_END = "CAST(NULL AS TIMESTAMP)"
_CHANGED = "b.preferences <> a.preferences OR b.name <> a.name"


@query(
    "scd2_initial",
    f"WITH {q.BEFORE_AFTER} SELECT {_HK1} AS customer_hk, *, {q.T1} AS eff_start_date, {_OPEN_END} AS eff_end_date, true AS is_current FROM before",
)
def scd2_initial(m):
    return m.customer_dim()


_EXPIRED_OR_CURRENT = f"""SELECT {_HK1} AS customer_hk, b.*, {q.T1} AS eff_start_date,
  CASE WHEN {_CHANGED} THEN {q.T2} END AS eff_end_date,
  NOT coalesce({_CHANGED}, false) AS is_current
  FROM (SELECT customer_id AS k, name, preferences FROM after) a RIGHT JOIN before b ON a.k = b.customer_id"""
_EXPIRED_OR_CURRENT = _EXPIRED_OR_CURRENT.replace(_HK1, q.hk("b.customer_id", "b.name", "b.preferences", q.instant(FIRST_LOAD)))
_OPENED = f"""SELECT {q.hk("a.customer_id", "a.name", "a.preferences", q.instant(SECOND_LOAD))}, a.*, {q.T2}, {_OPEN_END}, true
  FROM after a LEFT JOIN (SELECT customer_id AS k, name, preferences FROM before) b ON a.customer_id = b.k
  WHERE b.k IS NULL OR {_CHANGED}"""
_BATCH = f"{_EXPIRED_OR_CURRENT} UNION ALL {_OPENED}"


@query("scd2_batch", f"WITH {q.BEFORE_AFTER} {_BATCH}")
def scd2_batch(m):
    """The dimension after a batch with new, changed, unchanged and missing customers."""
    return scd2.apply_scd2(m.customers_next(), m.customer_dim(), KEY, HK, TRACKING, SECOND_LOAD)


@query(
    "scd2_metrics",
    f"""WITH {q.BEFORE_AFTER}, dim AS ({_BATCH}) SELECT count(*) FILTER (eff_start_date = {q.T2} AND is_current) AS new_versions,
        count(*) FILTER (eff_end_date = {q.T2} AND NOT is_current) AS expired FROM dim""",
)
def scd2_metrics(m):
    return scd2.scd2_metrics(scd2_batch(m), SECOND_LOAD)


@query(
    "scd2_classify",
    f"""WITH {q.BEFORE_AFTER} SELECT coalesce(b.customer_id, a.customer_id) AS customer_id,
        CASE WHEN b.customer_id IS NULL THEN 'NEW' WHEN a.customer_id IS NULL THEN 'MISSING'
          WHEN {_CHANGED} THEN 'CHANGED' ELSE 'UNCHANGED' END AS status
        FROM before b FULL JOIN after a ON b.customer_id = a.customer_id""",
)
def scd2_classify(m):
    return scd2.classify(m.customers_next(), m.customer_dim(), KEY, TRACKING)


@query(
    "scd2_changed",
    f"WITH {q.BEFORE_AFTER} SELECT a.* FROM after a JOIN before b ON a.customer_id = b.customer_id WHERE {_CHANGED}",
)
def scd2_changed(m):
    return scd2.changed_rows(m.customers_next(), m.customer_dim(), KEY, TRACKING)


@query(
    "scd2_new",
    f"WITH {q.BEFORE_AFTER} SELECT * FROM after a WHERE NOT EXISTS (SELECT 1 FROM before b WHERE b.customer_id = a.customer_id)",
)
def scd2_new(m):
    return scd2.new_rows(m.customers_next(), m.customer_dim(), KEY)


@query(
    "match_all_attributes",
    """SELECT o_orderkey AS order_key, o_custkey AS customer, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS priority
       FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice < 100000""",
)
def match_all_attributes(m):
    """Rows equal in every attribute, NULLs included: pending orders have no priority on either side."""
    priority = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    left = m.table("orders").select(
        F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("customer"), priority.alias("priority")
    )
    raised = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= 100000)
    right = m.table("orders").select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_custkey").alias("customer"),
        F.when(raised, F.lit("0-RAISED")).otherwise(priority).alias("priority"),
    )
    return scd2.match_all_attributes(left, right, ["order_key", "customer", "priority"])


_DELETED_AT = "TIMESTAMP '2001-06-01 12:00:00'"
_AFTER_DELETE = f"""SELECT {_HK1} AS customer_hk, customer_id, name, preferences, {q.T1} AS eff_start_date,
  CASE WHEN gone THEN {_DELETED_AT} END AS eff_end_date, NOT gone AS is_current, gone AS is_deleted,
  CASE WHEN gone THEN 'Account closed' END AS delete_reason
  FROM (SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS preferences, c_acctbal < 0 AS gone FROM customer)"""


@query("scd2_delete", _AFTER_DELETE)
def scd2_delete(m):
    """Closed accounts end at the time of the request; no version follows."""
    return scd2.scd2_delete(m.customer_dim(), m.customer_deletes(), KEY)


@query(
    "scd2_reactivate",
    f"""WITH dim AS ({_AFTER_DELETE}) SELECT * FROM dim
        UNION ALL SELECT {_HK3}, customer_id, name, preferences, TIMESTAMP '{REACTIVATED}', {_OPEN_END}, true, false, NULL
        FROM dim WHERE is_deleted""",
)
def scd2_reactivate(m):
    """Deleted customers come back: they have no current version, so they count as new."""
    return scd2.apply_scd2(m.customers(), scd2_delete(m), KEY, HK, TRACKING, REACTIVATED)


@query(
    "scd2_history",
    f"""WITH kept AS (SELECT * FROM (SELECT user_id, event_type, ts,
          lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)
          WHERE prev IS NULL OR prev <> event_type)
        SELECT {q.hk("user_id", "event_type", "epoch_us(ts)")} AS user_hk, user_id, event_type, ts AS eff_start_date,
          lead(ts) OVER w AS eff_end_date, lead(ts) OVER w IS NULL AS is_current
        FROM kept WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
)
def scd2_history(m):
    """Every state a user went through, replayed in one pass."""
    events = m.table("events").select("user_id", "event_type", "ts", "event_id")
    return replay(events, "user_id", ["event_type"], "ts", "user_hk", tiebreak="event_id")


@query("scd2_late_batch", ORACLES["scd2_history"])
def scd2_late_batch(m):
    """The same states from events in three batches, none in order: later ones cut versions of earlier ones."""
    events = m.table("events").select("user_id", "event_type", "ts", (F.col("event_id") % 3).alias("part"))
    dim = repeats = None
    for part in (1, 2, 0):
        dim, repeats = splice_scd2(events.filter(F.col("part") == part), dim, repeats, "user_id", "user_hk", ["event_type"], "ts")
        dim, repeats = stored(dim, "user-dim"), stored(repeats, "user-repeats")
    return dim


@query(
    "scd2_history_hot",
    """WITH daily AS (SELECT o_orderstatus AS status, o_orderdate AS ts, arg_max(o_orderpriority, o_orderkey) AS priority
          FROM orders GROUP BY 1, 2),
        kept AS (SELECT * FROM (SELECT *, lag(priority) OVER (PARTITION BY status ORDER BY ts) AS prev FROM daily)
          WHERE prev IS NULL OR prev <> priority)
        SELECT status, priority, ts AS eff_start_date, lead(ts) OVER w AS eff_end_date, lead(ts) OVER w IS NULL AS is_current
        FROM kept WINDOW w AS (PARTITION BY status ORDER BY ts)""",
)
def scd2_history_hot(m):
    """Three keys hold all rows: each is cut along time and the pieces are joined at their borders."""
    rows = m.table("orders").select(
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("order_key"),
    )
    return replay(rows, "status", ["priority"], "ts", tiebreak="order_key", share=0.01, min_rows=10)


@query(
    "scd2_from_cdc",
    f"""WITH {q.BEFORE_AFTER}
        SELECT {q.hk("b.customer_id", "b.name", "b.preferences", q.instant(FIRST_LOAD))} AS customer_hk, b.*, {q.T1} AS eff_start_date,
          CASE WHEN a.k IS NULL OR {_CHANGED} THEN {q.T2} END AS eff_end_date, NOT (a.k IS NULL OR {_CHANGED}) AS is_current
        FROM (SELECT customer_id AS k, name, preferences FROM after) a RIGHT JOIN before b ON a.k = b.customer_id
        UNION ALL {_OPENED}""",
)
def scd2_from_cdc(m):
    """The dimension from a change feed: here customers missing from the new state are deletes."""
    feed = change_feed(m.customers(), m.customers_next(), KEY)
    return scd2.apply_changes_scd2(m.customer_dim(), feed, KEY, HK, TRACKING, SECOND_LOAD)


_PAIRS = f"""SELECT b.*, 'DELETE' AS action, a.k IS NOT NULL AS is_update
  FROM before b LEFT JOIN (SELECT customer_id AS k, name, preferences FROM after) a ON a.k = b.customer_id
  WHERE a.k IS NULL OR {_CHANGED}
  UNION ALL SELECT a.*, 'INSERT', b.k IS NOT NULL
  FROM after a LEFT JOIN (SELECT customer_id AS k, name, preferences FROM before) b ON a.customer_id = b.k
  WHERE b.k IS NULL OR {_CHANGED}"""


@query("cdc_change_feed", f"WITH {q.BEFORE_AFTER} {_PAIRS}")
def cdc_change_feed(m):
    return change_feed(m.customers(), m.customers_next(), KEY)


@query(
    "version_diff",
    f"""WITH {q.BEFORE_AFTER} (SELECT 'Only in Version 1' AS diff_type, * FROM before EXCEPT SELECT 'Only in Version 1', * FROM after)
        UNION ALL (SELECT 'Only in Version 2', * FROM after EXCEPT SELECT 'Only in Version 2', * FROM before)""",
)
def version_diff(m):
    return diff_versions(m.customers(), m.customers_next())


@query(
    "latest_per_key",
    f"WITH {q.ITEMS} SELECT order_item_id, order_id AS order_id_fk, menu_id AS menu_id_fk, CAST(quantity AS DOUBLE) AS quantity, "
    "CAST(price AS DOUBLE) AS price, CAST(subtotal AS DOUBLE) AS subtotal, modified_dt FROM items",
)
def latest_per_key(m):
    """Order lines come several times; the latest shipment of each stays, ties broken by all columns."""
    return pick_latest(m.order_lines(), ["order_item_id", "order_id_fk"], "modified_dt")


@query(
    "hash_keys",
    f"""SELECT o_orderkey, {q.hk("o_orderkey")} AS natural_hk, {q.hk("o_orderkey", "o_custkey")} AS pair_hk,
        {q.hk("CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END", "CAST(o_totalprice AS DECIMAL(12,2))", "o_orderdate")} AS attributes_hk,
        {q.hk("o_orderpriority || '|'", "CASE WHEN o_orderstatus = 'F' THEN '<null>' WHEN o_orderstatus = 'P' THEN '|-' END")} AS text_hk
        FROM orders""",
)
def hash_keys(m):
    """Natural, composite and attribute keys; NULL attributes count, and so do pipes and marker texts."""
    rows = m.table("orders").withColumns(
        {
            "priority": F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")),
            "total": F.col("o_totalprice").cast("decimal(12,2)"),
        }
    )
    return rows.select(
        "o_orderkey",
        hash_key("o_orderkey").alias("natural_hk"),
        hash_key("o_orderkey", "o_custkey").alias("pair_hk"),
        change_hash(["priority", "total", "o_orderdate"]).alias("attributes_hk"),
        hash_key(
            F.concat("o_orderpriority", F.lit("|")),
            F.when(F.col("o_orderstatus") == "F", "<null>").when(F.col("o_orderstatus") == "P", "|-"),
        ).alias("text_hk"),
    )

"""Upserts and deletes on silver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.deletes import hard_delete, soft_delete
from ..operators.upsert import upsert
from ..sources.marketplace import FIRST_LOAD, SECOND_LOAD, money
from . import sql as q
from .registry import query


def _with_audit(df):
    first = F.lit(FIRST_LOAD).cast("timestamp")
    return df.withColumns({"_updated_at": first, "_inserted_at": first})


@query(
    "upsert_customer",
    f"""WITH {q.BEFORE_AFTER} SELECT coalesce(b.customer_id, a.customer_id) AS customer_id, coalesce(a.name, b.name) AS name,
        coalesce(a.preferences, b.preferences) AS preferences,
        CASE WHEN a.customer_id IS NULL THEN {q.T1} ELSE {q.T2} END AS _updated_at,
        CASE WHEN b.customer_id IS NULL THEN {q.T2} ELSE {q.T1} END AS _inserted_at
        FROM before b FULL JOIN after a ON b.customer_id = a.customer_id""",
)
def upsert_customer(m):
    """Unconditional: every matched row is overwritten and stamped."""
    return upsert(_with_audit(m.customers()), m.customers_next(), "customer_id", batch_ts=SECOND_LOAD)


@query(
    "upsert_location",
    f"""SELECT s_suppkey AS site_id, CASE WHEN s_acctbal > 5000 THEN 'Tier-1' ELSE 'Tier-3' END AS city_tier,
        CASE WHEN s_acctbal < 0 THEN NULL ELSE 'Y' END AS active_flag,
        CASE WHEN s_acctbal < 0 OR s_acctbal > 5000 THEN {q.T2} ELSE {q.T1} END AS _updated_at, {q.T1} AS _inserted_at FROM supplier""",
)
def upsert_location(m):
    """Only rows that differ are updated; a value that becomes NULL differs too."""
    supplier = m.table("supplier")
    before = supplier.select(
        F.col("s_suppkey").alias("site_id"), F.lit("Tier-3").alias("city_tier"), F.lit("Y").alias("active_flag")
    )
    after = supplier.select(
        F.col("s_suppkey").alias("site_id"),
        F.when(F.col("s_acctbal") > 5000, F.lit("Tier-1")).otherwise(F.lit("Tier-3")).alias("city_tier"),
        F.when(F.col("s_acctbal") >= 0, F.lit("Y")).alias("active_flag"),
    )
    return upsert(_with_audit(before), after, "site_id", only_if_changed=True, batch_ts=SECOND_LOAD)


@query(
    "upsert_orders_partial",
    """SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'O' THEN -1 ELSE o_custkey END AS customer_id_fk,
       CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS DOUBLE) END AS total_amount,
       CASE o_orderstatus WHEN 'P' THEN 'P' ELSE 'CLOSED' END AS status FROM orders""",
)
def upsert_orders_partial(m):
    """Late updates of open orders may change amount and status but not the customer.

    The table holds pending and finished orders; the batch brings finished ones again, with another
    customer that must be ignored, and open ones for the first time.
    """
    orders = m.table("orders")
    columns = [F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id_fk")]
    held = orders.filter(F.col("o_orderstatus") != "O").select(
        *columns, F.lit(0).cast("decimal(10,2)").alias("total_amount"), F.col("o_orderstatus").alias("status")
    )
    batch = orders.filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("order_id"),
        F.lit(-1).cast("bigint").alias("customer_id_fk"),
        money("o_totalprice").alias("total_amount"),
        F.lit("CLOSED").alias("status"),
    )
    return upsert(held, batch, "order_id", update_columns=["total_amount", "status"])


@query(
    "upsert_order_item",
    f"""WITH {q.ITEMS} SELECT order_item_id, order_id AS order_id_fk, menu_id AS menu_id_fk,
        CAST(CASE WHEN modified_dt < TIMESTAMP '1998-01-01' THEN quantity ELSE quantity + 1 END AS DOUBLE) AS quantity
        FROM items WHERE NOT (modified_dt >= TIMESTAMP '2001-01-01' AND quantity > 45)""",
)
def upsert_order_item(m):
    """Composite key of three columns, with a delete condition that wins over the update."""
    items = m.order_items().select("order_item_id", "order_id_fk", "menu_id_fk", "quantity", "modified_dt")
    batch = items.filter(F.col("modified_dt") >= F.lit("1998-01-01").cast("timestamp")).withColumn(
        "quantity", (F.col("quantity") + 1).cast("decimal(10,2)")
    )
    cancelled = (F.col("source.modified_dt") >= F.lit("2001-01-01").cast("timestamp")) & (
        F.col("target.quantity") > 45
    )
    return upsert(
        items, batch, ["order_item_id", "order_id_fk", "menu_id_fk"], delete_condition=cancelled
    ).drop("modified_dt")


@query(
    "silver_soft_delete",
    """SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS preferences, c_acctbal < 0 AS is_deleted,
       CASE WHEN c_acctbal < 0 THEN 'Account closed' END AS delete_reason,
       CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2001-06-01 12:00:00' END AS delete_timestamp FROM customer""",
)
def silver_soft_delete(m):
    return soft_delete(m.customers(), m.customer_deletes(), "customer_id")


_REQUESTS = "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 450000"


@query(
    "hard_delete_audit",
    f"""WITH req AS ({_REQUESTS})
        SELECT 'kept' AS part, CAST(o_orderkey AS VARCHAR) AS key_text, NULL::VARCHAR AS delete_reason, NULL::VARCHAR AS deleted_by
        FROM orders WHERE o_custkey NOT IN (SELECT k FROM req)
        UNION ALL SELECT 'audit', CAST(k AS VARCHAR), 'GDPR Request', 'System' FROM req""",
)
def hard_delete_audit(m):
    """All orders of some customers are removed; the audit has one row per customer and no data."""
    requests = m.table("orders").filter(F.col("o_totalprice") > 450000).select(
        "o_custkey",
        F.lit("GDPR Request").alias("delete_reason"),
        F.col("o_orderdate").cast("timestamp").alias("delete_timestamp"),
    )
    kept, audit = hard_delete(m.table("orders").select("o_orderkey", "o_custkey"), requests, "o_custkey", "ORDERS")
    return kept.select(
        F.lit("kept").alias("part"),
        F.col("o_orderkey").cast("string").alias("key_text"),
        F.lit(None).cast("string").alias("delete_reason"),
        F.lit(None).cast("string").alias("deleted_by"),
    ).unionByName(
        audit.select(
            F.lit("audit").alias("part"), F.col("primary_key_value").alias("key_text"), "delete_reason", "deleted_by"
        )
    )

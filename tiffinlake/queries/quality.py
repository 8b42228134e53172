"""Data-quality checks over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as dq
from ..plans import entities as en
from . import sql as q
from .registry import query


def _gappy_orders(m):
    """Orders whose pending rows lack a priority, with NaN totals where finished ones are cheap."""
    status = F.col("o_orderstatus")
    cheap = (status == "F") & (F.col("o_totalprice") < 50000)
    return m.table("orders").select(
        "o_orderkey",
        F.when(status != "P", F.col("o_orderpriority")).alias("priority"),
        F.when(cheap, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("total"),
        F.when(status != "O", F.col("o_custkey")).alias("customer"),
    )


_NULLS = """SELECT 'o_orderkey' AS column_name, 0::BIGINT AS n UNION ALL
  SELECT 'priority', count(*) FILTER (o_orderstatus = 'P') FROM orders UNION ALL
  SELECT 'total', count(*) FILTER (o_orderstatus = 'F' AND o_totalprice < 50000) FROM orders UNION ALL
  SELECT 'customer', count(*) FILTER (o_orderstatus = 'O') FROM orders"""


@query("dq_nulls", f"SELECT column_name, n AS null_count FROM ({_NULLS})")
def dq_nulls(m):
    return dq.null_counts(_gappy_orders(m))


_PK = """SELECT 'l_orderkey,l_linenumber' AS pk_column, count(*) AS total_records,
  count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_values, 0::BIGINT AS null_values,
  count(DISTINCT (l_orderkey, l_linenumber)) = count(*) AS is_unique FROM lineitem"""


@query("dq_primary_key", _PK)
def dq_primary_key(m):
    """Line numbers repeat within an order, so the declared key is not one."""
    return dq.primary_key(m.table("lineitem"), ["l_orderkey", "l_linenumber"])


_PARTS = "(SELECT p_partkey FROM part WHERE p_type <> 'SMALL')"


@query(
    "dq_foreign_key",
    f"""SELECT 'menu' AS fk_column, count(DISTINCT menu) AS distinct_values, count(*) FILTER (menu IS NULL) AS null_values,
        count(DISTINCT menu) FILTER (menu NOT IN {_PARTS}) AS orphaned_values
        FROM (SELECT CASE WHEN l_returnflag <> 'A' THEN l_partkey END AS menu FROM lineitem)""",
)
def dq_foreign_key(m):
    lines = m.table("lineitem").select(F.when(F.col("l_returnflag") != "A", F.col("l_partkey")).alias("menu"))
    parts = m.table("part").filter(F.col("p_type") != "SMALL")
    return dq.foreign_key(lines, "menu", parts, "p_partkey")


@query(
    "dq_orphan_examples",
    f"""SELECT l_partkey, count(*) AS row_count FROM lineitem WHERE l_partkey NOT IN {_PARTS}
        GROUP BY 1 ORDER BY 1 LIMIT 5""",
)
def dq_orphan_examples(m):
    """The report's first five orphaned values."""
    parts = m.table("part").filter(F.col("p_type") != "SMALL")
    return dq.orphan_examples(m.table("lineitem"), "l_partkey", parts, "p_partkey")


@query(
    "dq_histogram",
    """WITH r AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 10.0::DOUBLE AS w FROM orders),
       c AS (SELECT CAST(least(floor((o_totalprice - lo) / w), 9) AS INTEGER) AS bin, count(*) AS n FROM orders, r GROUP BY 1)
       SELECT b.bin, round(lo + b.bin * w, 6) AS bin_min, round(lo + (b.bin + 1) * w, 6) AS bin_max, coalesce(n, 0) AS row_count
       FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) b CROSS JOIN r LEFT JOIN c ON b.bin = c.bin""",
)
def dq_histogram(m):
    bins = dq.histogram(m.table("orders"), "o_totalprice")
    return bins.withColumns({c: F.round(c, 6) for c in ("bin_min", "bin_max")})


@query(
    "dq_summary",
    """SELECT 'l_extendedprice' AS column_name, count(l_extendedprice) AS value_count, round(avg(l_extendedprice), 4) AS mean,
       round(stddev_samp(l_extendedprice), 4) AS stddev, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem""",
)
def dq_summary(m):
    stats = dq.summary(m.table("lineitem"), "l_extendedprice")
    return stats.withColumns({c: F.round(c, 4) for c in ("mean", "stddev")})


@query(
    "dq_duplicates",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def dq_duplicates(m):
    return dq.duplicates(m.table("lineitem"), ["l_orderkey", "l_linenumber"])


_REPORT = f"""SELECT 'not_null' AS check_name, column_name AS target, n AS value, n = 0 AS ok FROM ({_NULLS})
  UNION ALL SELECT 'primary_key', 'o_orderkey', count(*) - count(DISTINCT o_orderkey), count(*) = count(DISTINCT o_orderkey) FROM orders
  UNION ALL SELECT 'foreign_key', 'customer', n, n = 0 FROM (SELECT count(DISTINCT o_custkey) FILTER (c_acctbal < 0) AS n
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'O')
  UNION ALL SELECT 'duplicates', 'priority,customer', count(*), count(*) = 0 FROM (
    SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS p, CASE WHEN o_orderstatus <> 'O' THEN o_custkey END AS c
    FROM orders GROUP BY 1, 2 HAVING count(*) > 1)"""


def _report(m):
    return dq.quality_report(
        _gappy_orders(m),
        pk="o_orderkey",
        fks={"customer": (m.table("customer").filter(F.col("c_acctbal") >= 0), "c_custkey")},
        duplicate_columns=["priority", "customer"],
    )


@query("dq_report", _REPORT)
def dq_report(m):
    return _report(m)


@query(
    "dq_verdict",
    f"SELECT count(*) AS checks, count(*) FILTER (NOT ok) AS failed, bool_or(NOT ok) AS has_issues FROM ({_REPORT})",
)
def dq_verdict(m):
    return dq.verdict(_report(m))


@query(
    "dq_constraints",
    """WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS i, l_orderkey AS o, l_partkey AS p FROM lineitem),
       g AS (SELECT count(*) AS n FROM (SELECT 1 FROM s GROUP BY i, o, p HAVING count(*) > 1)),
       k AS (SELECT count(*) - count(DISTINCT (i, o, p)) AS n FROM s)
       SELECT 'not_null' AS check_name, t AS target, 0::BIGINT AS value, true AS ok
         FROM (VALUES ('order_item_id'), ('order_id_fk'), ('menu_id_fk')) v(t)
       UNION ALL SELECT 'primary_key', 'order_item_id,order_id_fk,menu_id_fk', n, n = 0 FROM k
       UNION ALL SELECT 'duplicates', 'order_item_id,order_id_fk,menu_id_fk', n, n = 0 FROM g
       UNION ALL SELECT 'foreign_key', 'order_id_fk', n, n = 0 FROM (SELECT count(DISTINCT o) AS n FROM s WHERE o NOT IN (SELECT o_orderkey FROM orders))
       UNION ALL SELECT 'foreign_key', 'menu_id_fk', n, n = 0 FROM (SELECT count(DISTINCT p) AS n FROM s WHERE p NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'SMALL'))""",
)
def dq_constraints(m):
    """What the order-item entity declares, checked against its parents."""
    refs = {"orders": m.orders(), "menu": m.menu().filter(F.col("category") != "SMALL")}
    return dq.check_constraints(m.order_lines(), en.ORDER_ITEM, refs)


@query(
    "reconcile_layers",
    f"""WITH {q.ITEMS}, t AS (
          SELECT 'bronze' AS layer, count(*)::DOUBLE AS row_count, sum(subtotal)::DOUBLE AS subtotal FROM lines
          UNION ALL SELECT 'silver', count(*), sum(subtotal) FROM items
          UNION ALL SELECT 'gold', count(*), sum(subtotal) FROM items),
        u AS (SELECT layer, 'row_count' AS metric, row_count AS value FROM t UNION ALL SELECT layer, 'subtotal', subtotal FROM t)
        SELECT u.layer, u.metric, u.value, b.value AS expected, u.value = b.value AS ok
        FROM u JOIN u b ON u.metric = b.metric AND b.layer = 'bronze'""",
)
def reconcile_layers(m):
    """Bronze holds repeated lines that silver drops; gold must match silver."""
    return dq.reconcile(
        {"bronze": m.order_lines(), "silver": m.order_items(), "gold": m.fact}, ["subtotal"]
    )


@query(
    "completeness_gate",
    """SELECT e AS entity, '1996-02-29' AS execution_date FROM (VALUES ('F'), ('O'), ('P'), ('R')) v(e)
       WHERE e NOT IN (SELECT o_orderstatus FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1996-02-29')""",
)
def completeness_gate(m):
    """Feeds (here one per order status) that delivered nothing for a date; R never delivers."""
    loads = m.table("orders").select(
        F.col("o_orderstatus").alias("entity"), F.col("o_orderdate").alias("_execution_date")
    )
    return dq.missing_entities(m.spark, loads, ["F", "O", "P", "R"], "1996-02-29")

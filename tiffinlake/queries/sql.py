"""SQL fragments shared by the reference queries (DuckDB over the same Parquet tables)."""

from __future__ import annotations

from ..functions import fixed_values as fv
from ..sources.marketplace import FIRST_LOAD, NEW_CUSTOMER_BASE, SECOND_LOAD

T1, T2 = f"TIMESTAMP '{FIRST_LOAD}'", f"TIMESTAMP '{SECOND_LOAD}'"


def text_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def hk(*parts: str) -> str:
    """Surrogate key over SQL expressions: length, colon and text of each, a dash for NULL."""
    texts = [f"CAST({p} AS VARCHAR)" for p in parts]
    return "sha256(" + " || ".join(f"coalesce(length({t}) || ':' || {t}, '-')" for t in texts) + ")"


def instant(text: str) -> str:
    return f"epoch_us(TIMESTAMP '{text}')"


def money(c: str) -> str:
    return f"CAST({c} AS DECIMAL(10,2))"


def half_up(numerator: str, denominator: str) -> str:
    """numerator / denominator rounded half up to cents, in whole numbers: exact, unlike doubles."""
    cents = f"CAST(({numerator}) * 100 AS HUGEINT)"
    return f"CAST((2 * {cents} + {denominator}) // (2 * {denominator}) AS DOUBLE) / 100"


ITEMS = """
lines AS (
  SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id, l_partkey AS menu_id,
         CAST(l_quantity AS DECIMAL(10,2)) AS quantity,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS price,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(10,2)) AS subtotal,
         l_shipdate AS modified_dt
  FROM lineitem
),
items AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY order_item_id, order_id
      ORDER BY modified_dt DESC, menu_id DESC, quantity DESC, price DESC, subtotal DESC) AS rn
    FROM lines)
  WHERE rn = 1
)"""

ORDER_HEADS = """
heads AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
         CASE o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'In Transit' ELSE 'Pending' END AS delivery_status,
         o_orderpriority AS estimated_time, s.supplier
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS supplier FROM lineitem GROUP BY 1) s
    ON o_orderkey = s.l_orderkey
)"""

CUSTOMER_HK = hk("c_custkey", "c_name", "c_mktsegment", instant(FIRST_LOAD))
ADDRESS_HK = hk("c_custkey", "c_custkey", "c_nationkey", instant(FIRST_LOAD))
RESTAURANT_HK = hk("s_suppkey", "s_name", "s_nationkey", money("s_acctbal"), instant(FIRST_LOAD))
AGENT_HK = hk("s_suppkey", "s_name", "s_nationkey", instant(FIRST_LOAD))
MENU_HK = hk("p_partkey", "p_name", "p_type", money("p_retailprice"), instant(FIRST_LOAD))
LOCATION_HK = hk("n_nationkey", "n_name", "r_name", "n_nationkey + 560000", instant(FIRST_LOAD))


def fact_cte(join: str = "LEFT JOIN", restaurant_filter: str = "true", menu_filter: str = "true") -> str:
    """The fact as CTE ``fact``; filters thin out dimensions to leave keys unresolved."""
    return f"""{ITEMS}, {ORDER_HEADS},
fact AS (
  SELECT {hk("i.order_item_id", "i.order_id")} AS order_item_fact_sk, i.order_item_id, i.order_id,
         c.hk AS customer_dim_key, a.hk AS customer_address_dim_key, r.hk AS restaurant_dim_key,
         l.hk AS restaurant_location_dim_key, m.hk AS menu_dim_key, g.hk AS delivery_agent_dim_key,
         sha256(CAST(CAST(h.order_date AS DATE) AS VARCHAR)) AS order_date_dim_key,
         i.quantity, i.price, i.subtotal, h.delivery_status, h.estimated_time, h.order_date
  FROM items i
  {join} heads h ON i.order_id = h.order_id
  {join} (SELECT c_custkey AS k, {CUSTOMER_HK} AS hk FROM customer) c ON h.customer_id = c.k
  {join} (SELECT c_custkey AS k, {ADDRESS_HK} AS hk FROM customer) a ON h.customer_id = a.k
  {join} (SELECT s_suppkey AS k, s_nationkey AS n, {RESTAURANT_HK} AS hk FROM supplier WHERE {restaurant_filter}) r ON h.supplier = r.k
  {join} (SELECT n_nationkey AS k, {LOCATION_HK} AS hk FROM nation JOIN region ON n_regionkey = r_regionkey) l ON r.n = l.k
  {join} (SELECT p_partkey AS k, {MENU_HK} AS hk FROM part WHERE {menu_filter}) m ON i.menu_id = m.k
  {join} (SELECT s_suppkey AS k, {AGENT_HK} AS hk FROM supplier) g ON h.supplier = g.k
)"""


FACT_COLUMNS = """order_item_fact_sk, order_item_id, order_id, customer_dim_key, customer_address_dim_key,
  restaurant_dim_key, restaurant_location_dim_key, menu_dim_key, delivery_agent_dim_key, order_date_dim_key,
  CAST(quantity AS DOUBLE) AS quantity, CAST(price AS DOUBLE) AS price, CAST(subtotal AS DOUBLE) AS subtotal,
  delivery_status, estimated_time"""

# Sales without the star: what the KPIs must add up to.
SALES = f"""{ITEMS}, {ORDER_HEADS},
sales AS (
  SELECT i.order_item_id, i.order_id, i.subtotal, h.delivery_status, h.supplier,
         CAST(year(h.order_date) AS INTEGER) AS year, CAST(month(h.order_date) AS INTEGER) AS month,
         CAST(day(h.order_date) AS INTEGER) AS day, dayname(h.order_date) AS day_name, CAST(h.order_date AS DATE) AS order_day
  FROM items i JOIN heads h ON i.order_id = h.order_id
)"""

METRICS_EXACT = """sum(subtotal) AS total_revenue, count(DISTINCT order_id) AS total_orders,
  count(order_item_id) AS total_items, max(subtotal) AS max_order_value"""


def kpi_rows(groups: str, source: str = "sales", where: str = "delivery_status = 'Delivered'") -> str:
    """The five metrics per group as a subquery."""
    names = ", ".join(g.split(" AS ")[-1].strip() for g in groups.split(","))
    return f"""SELECT {names}, CAST(total_revenue AS DOUBLE) AS total_revenue, total_orders,
  {half_up("total_revenue", "total_orders")} AS avg_revenue_per_order,
  {half_up("total_revenue", "total_items")} AS avg_revenue_per_item,
  CAST(max_order_value AS DOUBLE) AS max_order_value
FROM (SELECT {groups}, {METRICS_EXACT} FROM {source} WHERE {where} GROUP BY ALL)"""


YEARLY = f"WITH {SALES}, yearly AS ({kpi_rows('year')})"

CUSTOMERS = "SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS preferences FROM customer"
CUSTOMERS_NEXT = f"""SELECT c_custkey AS customer_id, c_name AS name,
  CASE WHEN c_acctbal >= 5000 THEN 'PREMIUM' ELSE c_mktsegment END AS preferences
  FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT s_suppkey + {NEW_CUSTOMER_BASE}, s_name, 'SUPPLIER' FROM supplier"""
BEFORE_AFTER = f"before AS ({CUSTOMERS}), after AS ({CUSTOMERS_NEXT})"

STATE_CASE = "CASE {c} " + " ".join(f"WHEN '{s}' THEN '{k}'" for s, k in fv.STATE_CODES.items()) + " END"

"""Silver: typing, rules, lookups, quarantine and masking over raw text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import casting, fixed_values as fv, geography, rules
from ..operators.deletes import active_only, soft_delete
from ..operators.masking import mask
from ..operators.quarantine import bad_key_rules, split_valid
from ..plans import entities as en
from ..plans.silver import to_silver
from ..sources.marketplace import SECOND_LOAD
from . import sql as q
from .registry import query

CITIES = fv.TIER_1_CITIES + fv.TIER_2_CITIES
STATES = list(fv.STATE_CODES)


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _money_text(c: str) -> Column:
    return _text(F.col(c).cast("decimal(12,2)"))


def _iso(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def _spaced(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _raw(entity: en.Entity, df, **columns: Column):
    """A raw table of the entity: every column text, those not given NULL."""
    return df.select(
        *[columns.get(f.raw, F.lit(None).cast("string")).cast("string").alias(f.raw) for f in entity.fields]
    )


def _silver(entity: en.Entity, raw, **options):
    return to_silver(raw, entity, **options)


def raw_customer(m):
    df = m.table("customer")
    opened = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("c_custkey") % 9000).cast("int"))
    return _raw(
        en.CUSTOMER,
        df,
        customerid=_text("c_custkey"),
        name=F.col("c_name"),
        mobile=F.lpad(_text("c_custkey"), 10, "9"),
        email=F.concat(F.lower(F.col("c_name")), F.lit("@example.com")),
        loginbyusing=F.when(F.col("c_acctbal") > 0, F.lit("Google")),
        gender=F.when(F.col("c_acctbal") > 5000, F.lit("Female")).otherwise(F.lit("Male")),
        dob=F.when(F.col("c_mktsegment") == "BUILDING", F.lit("unknown")).otherwise(_text(opened)),
        anniversary=_text(opened),
        preferences=F.concat(F.lit('{"segment":"'), F.col("c_mktsegment"), F.lit('"}')),
        createddate=F.concat(_text(opened), F.lit("T09:30:45")),
        modifieddate=F.concat(_text(opened), F.lit("T09:30:45.5")),
    )


_OPENED = "(DATE '1990-01-01' + CAST(c_custkey % 9000 AS INTEGER))"


@query(
    "silver_customer",
    f"""SELECT c_custkey AS customer_id, c_name AS name, lpad(CAST(c_custkey AS VARCHAR), 10, '9') AS mobile,
       lower(c_name) || '@example.com' AS email, CASE WHEN c_acctbal > 0 THEN 'Google' END AS login_by_using,
       CASE WHEN c_acctbal > 5000 THEN 'Female' ELSE 'Male' END AS gender,
       CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST({_OPENED} AS VARCHAR) END AS dob,
       CAST({_OPENED} AS VARCHAR) AS anniversary, '{{"segment":"' || c_mktsegment || '"}}' AS preferences,
       CAST({_OPENED} AS TIMESTAMP) + INTERVAL '9 hours 30 minutes 45 seconds' AS created_dt,
       CAST({_OPENED} AS TIMESTAMP) + INTERVAL '9 hours 30 minutes 45.5 seconds' AS modified_dt,
       {q.T2} AS _silver_processed_dt
FROM customer""",
)
def silver_customer(m):
    return _silver(en.CUSTOMER, raw_customer(m), batch_ts=SECOND_LOAD)


def raw_location(m):
    """One location per customer: where they order from, with the usual mix of flag spellings."""
    segment = F.col("c_mktsegment")
    city = (
        F.when(segment == "BUILDING", F.lit("New Delhi"))
        .when(segment == "MACHINERY", F.lit("Mumbai"))
        .when(segment == "AUTOMOBILE", F.lit("Hyderabad"))
        .when(segment == "FURNITURE", F.col("c_name"))
        .otherwise(_pick(CITIES, F.col("c_nationkey") + 1))
    )
    flag = (
        F.when(segment == "BUILDING", F.lit("yes"))
        .when(segment == "MACHINERY", F.lit("INACTIVE"))
        .when(segment == "AUTOMOBILE", F.lit("Paused"))
        .when(F.col("c_acctbal") < 0, F.lit("0"))
        .otherwise(F.lit("1"))
    )
    return _raw(
        en.LOCATION,
        m.table("customer"),
        locationid=_text("c_custkey"),
        city=city,
        state=F.when(F.col("c_acctbal") > 9000, F.lit("Elsewhere")).otherwise(_pick(STATES, F.col("c_nationkey") + 1)),
        zipcode=_text(F.col("c_nationkey") + 400000),
        activeflag=flag,
        createddate=F.lit("2023-01-05 10:00:00"),
        modifieddate=F.lit("2023-01-05T10:00:00"),
    )


_LOCATIONS = f"""loc AS (SELECT c_custkey AS location_id,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'New Delhi' WHEN 'MACHINERY' THEN 'Mumbai' WHEN 'AUTOMOBILE' THEN 'Hyderabad'
    WHEN 'FURNITURE' THEN c_name ELSE ([{q.text_list(CITIES)}])[c_nationkey + 1] END AS city,
  CASE WHEN c_acctbal > 9000 THEN 'Elsewhere' ELSE ([{q.text_list(STATES)}])[c_nationkey + 1] END AS state,
  CAST(c_nationkey + 400000 AS VARCHAR) AS zip_code,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Y' WHEN 'MACHINERY' THEN 'N' WHEN 'AUTOMOBILE' THEN 'Paused'
    ELSE CASE WHEN c_acctbal < 0 THEN 'N' ELSE 'Y' END END AS active_flag FROM customer)"""
_STATE_CODE = q.STATE_CASE.format(c="state")
_TERRITORY = f"state IN ({q.text_list(fv.UNION_TERRITORIES)})"
_CAPITAL = "(" + " OR ".join(f"(state = '{s}' AND city = '{c}')" for s, c in fv.CAPITAL_CITIES) + ")"
_TIER = (
    f"CASE WHEN city IN ({q.text_list(fv.TIER_1_CITIES)}) THEN 'Tier-1' "
    f"WHEN city IN ({q.text_list(fv.TIER_2_CITIES)}) THEN 'Tier-2' ELSE 'Tier-3' END"
)


@query(
    "silver_location",
    f"""WITH {_LOCATIONS} SELECT location_id, city,
       CASE state WHEN 'Delhi' THEN 'New Delhi' ELSE state END AS state, zip_code, active_flag,
       TIMESTAMP '2023-01-05 10:00:00' AS created_ts, TIMESTAMP '2023-01-05 10:00:00' AS modified_ts,
       {_STATE_CODE} AS state_code, {_TERRITORY} AS is_union_territory, {_CAPITAL} AS capital_city_flag,
       {_TIER} AS city_tier FROM loc""",
)
def silver_location(m):
    return _silver(en.LOCATION, raw_location(m))


@query("location_state_code", f"WITH {_LOCATIONS} SELECT location_id, state, {_STATE_CODE} AS state_code FROM loc")
def location_state_code(m):
    state = F.col("state")
    return raw_location(m).select(
        F.col("locationid").cast("bigint").alias("location_id"),
        state,
        geography.state_code(state).alias("state_code"),
    )


@query(
    "location_flags",
    f"""WITH {_LOCATIONS} SELECT location_id, {_TERRITORY} AS is_union_territory, {_CAPITAL} AS capital_city_flag,
        active_flag FROM loc""",
)
def location_flags(m):
    return raw_location(m).select(
        F.col("locationid").cast("bigint").alias("location_id"),
        geography.is_union_territory(F.col("state")).alias("is_union_territory"),
        geography.is_capital(F.col("state"), F.col("city")).alias("capital_city_flag"),
        rules.yes_no_flag(F.col("activeflag")).alias("active_flag"),
    )


@query("location_city_tier", f"WITH {_LOCATIONS} SELECT location_id, city, {_TIER} AS city_tier FROM loc")
def location_city_tier(m):
    return raw_location(m).select(
        F.col("locationid").cast("bigint").alias("location_id"),
        F.col("city"),
        geography.city_tier(F.col("city")).alias("city_tier"),
    )


@query(
    "silver_restaurant",
    """SELECT s_suppkey AS restaurant_id, s_name AS name, 'North Indian|Chinese' AS cuisine_type,
       CASE WHEN s_acctbal >= 0 THEN CAST(CAST(s_acctbal AS DECIMAL(10,2)) AS DOUBLE) END AS pricing_for_two,
       lpad(CAST(s_suppkey AS VARCHAR), 10, '8') AS restaurant_phone, '10:00-23:00' AS operating_hours,
       CAST(s_nationkey AS BIGINT) AS location_id_fk, 'Y' AS active_flag, 'Open' AS open_status,
       NULL::VARCHAR AS locality, NULL::VARCHAR AS restaurant_address,
       CAST(CAST(s_nationkey + 0.125 AS DECIMAL(9,6)) AS DOUBLE) AS latitude, NULL::DOUBLE AS longitude,
       TIMESTAMP '2023-01-08 12:30:00.123456' AS created_dt, NULL::TIMESTAMP AS modified_dt FROM supplier""",
)
def silver_restaurant(m):
    """Tolerant casts: prices and coordinates that are no numbers become NULL."""
    raw = _raw(
        en.RESTAURANT,
        m.table("supplier"),
        restaurantid=_text("s_suppkey"),
        name=F.col("s_name"),
        cuisinetype=F.lit("North Indian|Chinese"),
        pricing_for_2=F.when(F.col("s_acctbal") >= 0, _money_text("s_acctbal")).otherwise(F.lit("ask")),
        restaurant_phone=F.lpad(_text("s_suppkey"), 10, "8"),
        operatinghours=F.lit("10:00-23:00"),
        locationid=_text("s_nationkey"),
        activeflag=F.lit("Y"),
        openstatus=F.lit("Open"),
        latitude=F.concat(_text("s_nationkey"), F.lit(".125")),
        longitude=F.lit("east"),
        createddate=F.lit("2023-01-08 12:30:00.123456"),
        modifieddate=F.lit("last week"),
    )
    return _silver(en.RESTAURANT, raw)


@query(
    "silver_menu",
    """SELECT p_partkey AS menu_id, p_partkey AS restaurant_id_fk, p_name AS item_name, p_brand AS description,
       CASE WHEN p_type <> 'SMALL' THEN CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DOUBLE) END AS price,
       p_type AS category, CASE p_type WHEN 'ECONOMY' THEN true WHEN 'SMALL' THEN false WHEN 'STANDARD' THEN true END AS availability,
       CASE WHEN p_size > 25 THEN 'Veg' ELSE 'Non-Veg' END AS item_type,
       TIMESTAMP '2023-01-09 11:00:00' AS created_dt, TIMESTAMP '2023-01-09 11:00:00' AS modified_dt FROM part""",
)
def silver_menu(m):
    """Trimmed text, tolerant price, availability spellings with NULL for unknown ones."""
    available = (
        F.when(F.col("p_type") == "ECONOMY", F.lit("true"))
        .when(F.col("p_type") == "SMALL", F.lit("No"))
        .when(F.col("p_type") == "STANDARD", F.lit("AVAILABLE"))
        .otherwise(F.lit("maybe"))
    )
    raw = _raw(
        en.MENU,
        m.table("part"),
        menuid=F.concat(_text("p_partkey"), F.lit(" ")),
        restaurantid=_text("p_partkey"),
        itemname=F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")),
        description=F.concat(F.col("p_brand"), F.lit(" ")),
        price=F.when(F.col("p_type") != "SMALL", _money_text("p_retailprice")).otherwise(F.lit("n/a")),
        category=F.concat(F.lit(" "), F.col("p_type")),
        availability=available,
        itemtype=F.when(F.col("p_size") > 25, F.lit("Veg")).otherwise(F.lit("Non-Veg")),
        createddate=F.lit("2023-01-09T11:00:00"),
        modifieddate=F.lit("2023-01-09 11:00:00"),
    )
    return _silver(en.MENU, raw)


@query(
    "silver_orders",
    """SELECT o_orderkey AS order_id, o_custkey AS customer_id_fk, NULL::BIGINT AS restaurant_id_fk,
       o_orderdate AS order_date, CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS DOUBLE) AS total_amount,
       o_orderstatus AS status, o_orderpriority AS payment_method, o_orderdate AS created_dt,
       o_orderdate AS modified_dt FROM orders""",
)
def silver_orders(m):
    raw = _raw(
        en.ORDERS,
        m.table("orders"),
        orderid=_text("o_orderkey"),
        customerid=_text("o_custkey"),
        restaurantid=F.lit("unknown"),
        orderdate=_iso("o_orderdate"),
        totalamount=_money_text("o_totalprice"),
        status=F.col("o_orderstatus"),
        paymentmethod=F.col("o_orderpriority"),
        createddate=_spaced("o_orderdate"),
        modifieddate=_text("o_orderdate"),
    )
    return _silver(en.ORDERS, raw)


@query(
    "silver_address",
    """SELECT c_custkey AS address_id, c_custkey AS customer_id_fk, 'A-' || c_nationkey AS flat_no,
       NULL::VARCHAR AS house_no, '3rd' AS floor, c_name AS building, NULL::VARCHAR AS landmark,
       c_mktsegment AS locality, CAST(c_nationkey AS VARCHAR) AS city, NULL::VARCHAR AS state,
       lpad(CAST(c_nationkey AS VARCHAR), 6, '5') AS pincode, '12.93|77.62' AS coordinates, 'Y' AS primary_flag,
       'Home' AS address_type, TIMESTAMP '2023-01-10 10:15:30' AS created_date,
       CASE WHEN c_acctbal >= 0 THEN TIMESTAMP '2023-02-20 11:05:45' END AS modified_date FROM customer""",
)
def silver_address(m):
    raw = _raw(
        en.CUSTOMER_ADDRESS,
        m.table("customer"),
        addressid=_text("c_custkey"),
        customerid=_text("c_custkey"),
        flatno=F.concat(F.lit("A-"), _text("c_nationkey")),
        floor=F.lit("3rd"),
        building=F.col("c_name"),
        locality=F.col("c_mktsegment"),
        city=_text("c_nationkey"),
        pincode=F.lpad(_text("c_nationkey"), 6, "5"),
        coordinates=F.lit("12.93|77.62"),
        primaryflag=F.lit("Y"),
        addresstype=F.lit("Home"),
        createddate=F.lit("2023-01-10T10:15:30"),
        modifieddate=F.when(F.col("c_acctbal") >= 0, F.lit("2023-02-20T11:05:45")).otherwise(F.lit("")),
    )
    return _silver(en.CUSTOMER_ADDRESS, raw)


@query(
    "silver_agent",
    """SELECT s_suppkey AS delivery_agent_id, s_name AS name, lpad(CAST(s_suppkey AS VARCHAR), 10, '7') AS phone,
       CASE WHEN s_acctbal > 5000 THEN 'Motorcycle' ELSE 'Bicycle' END AS vehicle_type,
       CAST(s_nationkey AS BIGINT) AS location_id_fk, 'Active' AS status, NULL::VARCHAR AS gender,
       CASE WHEN s_nationkey < 20 THEN CAST(CAST('4.' || s_nationkey AS DECIMAL(4,2)) AS DOUBLE) END AS rating,
       TIMESTAMP '2023-01-11 08:00:00' AS created_dt, TIMESTAMP '2023-01-11 00:00:00' AS modified_dt FROM supplier""",
)
def silver_agent(m):
    rating = F.when(F.col("s_nationkey") < 20, F.concat(F.lit("4."), _text("s_nationkey"))).otherwise(F.lit("new"))
    raw = _raw(
        en.DELIVERY_AGENT,
        m.table("supplier"),
        deliveryagentid=_text("s_suppkey"),
        name=F.col("s_name"),
        phone=F.lpad(_text("s_suppkey"), 10, "7"),
        vehicletype=F.when(F.col("s_acctbal") > 5000, F.lit("Motorcycle")).otherwise(F.lit("Bicycle")),
        locationid=_text("s_nationkey"),
        status=F.lit("Active"),
        rating=rating,
        createddate=F.lit("2023-01-11T08:00:00"),
        modifieddate=F.lit("2023-01-11"),
    )
    return _silver(en.DELIVERY_AGENT, raw)


@query(
    "silver_delivery",
    """SELECT o_orderkey AS delivery_id, o_orderkey AS order_id_fk, CAST(NULL AS BIGINT) AS delivery_agent_id_fk,
       CASE o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'In Transit' ELSE 'Pending' END AS delivery_status,
       '30 minutes' AS estimated_time, o_custkey AS customer_address_id_fk,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 45 MINUTE END AS delivery_date,
       o_orderdate AS created_date, o_orderdate AS modified_date FROM orders""",
)
def silver_delivery(m):
    from ..sources.marketplace import delivery_status

    arrived = F.col("o_orderdate") + F.expr("INTERVAL 45 MINUTES")
    raw = _raw(
        en.DELIVERY,
        m.table("orders"),
        deliveryid=_text("o_orderkey"),
        orderid=_text("o_orderkey"),
        deliveryagentid=F.lit("tbd"),
        deliverystatus=delivery_status(),
        estimatedtime=F.lit("30 minutes"),
        addressid=_text("o_custkey"),
        deliverydate=F.when(F.col("o_orderstatus") == "F", _iso(arrived)),
        createddate=_spaced("o_orderdate"),
        modifieddate=_iso("o_orderdate"),
    )
    return _silver(en.DELIVERY, raw)


@query(
    "silver_order_item",
    """SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id_fk, l_partkey AS menu_id_fk,
       CASE WHEN l_returnflag <> 'R' THEN CAST(CAST(l_quantity AS DECIMAL(10,2)) AS DOUBLE) END AS quantity,
       CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS DOUBLE) AS price,
       CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS DOUBLE) AS subtotal,
       l_shipdate AS created_dt, l_shipdate AS modified_dt FROM lineitem""",
)
def silver_order_item(m):
    raw = _raw(
        en.ORDER_ITEM,
        m.table("lineitem"),
        orderitemid=_text(F.col("l_orderkey") * 10 + F.col("l_linenumber")),
        orderid=_text("l_orderkey"),
        menuid=_text("l_partkey"),
        quantity=F.when(F.col("l_returnflag") != "R", _money_text("l_quantity")).otherwise(F.lit("returned")),
        price=_money_text("l_extendedprice"),
        subtotal=_money_text("l_extendedprice"),
        createddate=_iso("l_shipdate"),
        modifieddate=_spaced("l_shipdate"),
    )
    return _silver(en.ORDER_ITEM, raw)


@query(
    "try_cast_fields",
    """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN CAST(l_quantity AS BIGINT) END AS quantity,
       CASE WHEN l_returnflag <> 'N' THEN CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS DOUBLE) END AS price,
       CASE WHEN l_linestatus = 'F' THEN true END AS shipped FROM lineitem""",
)
def try_cast_fields(m):
    """Numbers and booleans out of text that sometimes is neither."""
    flag = F.col("l_returnflag")
    quantity = F.when(flag == "A", _text(F.col("l_quantity").cast("int"))).when(flag == "R", F.lit("twelve"))
    price = F.when(flag == "N", F.concat(F.lit("Rs "), _money_text("l_extendedprice"))).otherwise(
        _money_text("l_extendedprice")
    )
    return m.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        casting.cast_text(quantity, "bigint").alias("quantity"),
        casting.cast_text(price, "decimal(10,2)").alias("price"),
        casting.cast_text(F.when(F.col("l_linestatus") == "F", F.lit("true")).otherwise(F.lit("?")), "boolean").alias(
            "shipped"
        ),
    )


@query(
    "strict_cast_fields",
    """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity,
       CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS DOUBLE) AS price, l_linestatus = 'F' AS shipped,
       CAST(l_shipdate AS TIMESTAMP) AS shipped_at FROM lineitem""",
)
def strict_cast_fields(m):
    """Text that must be of its type: here it always is; a unit test has the value that fails the job."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")
    return m.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        casting.cast_text(_text(F.col("l_quantity").cast("int")), "bigint", strict=True).alias("quantity"),
        casting.cast_text(_money_text("l_extendedprice"), "decimal(10,2)", strict=True).alias("price"),
        casting.cast_text(_text(F.col("l_linestatus") == "F"), "boolean", strict=True).alias("shipped"),
        casting.parse_timestamp(day, strict=True).alias("shipped_at"),
    )


@query(
    "parse_timestamps",
    """SELECT event_id, CASE event_type WHEN 'signup' THEN date_trunc('second', ts) WHEN 'click' THEN ts
       WHEN 'view' THEN ts WHEN 'purchase' THEN date_trunc('day', ts) END AS parsed,
       CAST(CASE event_type WHEN 'purchase' THEN CAST(ts AS DATE) END AS VARCHAR) AS parsed_date FROM events""",
)
def parse_timestamps(m):
    """Four spellings of a time and one that is none."""
    kind, ts = F.col("event_type"), F.col("ts")
    text = (
        F.when(kind == "signup", _iso("ts"))
        .when(kind == "click", F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(kind == "view", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(kind == "purchase", F.date_format(ts, "yyyy-MM-dd"))
        .otherwise(F.lit("15th of last month"))
    )
    return m.table("events").select(
        "event_id",
        casting.parse_timestamp(text).alias("parsed"),
        casting.parse_date(text).alias("parsed_date"),
    )


@query(
    "fill_na",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, 'N/A') AS payment_method,
       coalesce(CASE WHEN o_totalprice > 1000 THEN o_orderstatus END, 'N/A') AS status,
       CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS customer FROM orders""",
)
def fill_na(m):
    open_order = F.col("o_orderstatus") != "P"
    rows = m.table("orders").select(
        "o_orderkey",
        F.when(open_order, F.col("o_orderpriority")).alias("payment_method"),
        F.when(F.col("o_totalprice") > 1000, F.col("o_orderstatus")).alias("status"),
        F.when(open_order, F.col("o_custkey")).alias("customer"),
    )
    return rules.fill_missing_text(rows)


@query(
    "category_rule",
    """SELECT event_id, event_type, CASE WHEN event_type IN ('click', 'view') THEN 'BROWSE' ELSE 'ACT' END AS category,
       CASE WHEN event_type IN ('error') THEN 'FAULT' END AS fault FROM events""",
)
def category_rule(m):
    kind = F.col("event_type")
    return m.table("events").select(
        "event_id",
        "event_type",
        rules.category_rule(kind, ["click", "view"], "BROWSE", F.lit("ACT")).alias("category"),
        rules.category_rule(kind, ["error"], "FAULT").alias("fault"),
    )


@query(
    "quarantine_rows",
    """SELECT CASE event_type WHEN 'error' THEN event_id || '|' || user_id WHEN 'signup' THEN event_id || 'junk'
         WHEN 'view' THEN NULL ELSE CAST(event_id AS VARCHAR) END AS event_key, value,
       CASE event_type WHEN 'error' THEN 'wrong_delimiter' WHEN 'signup' THEN 'junk' ELSE '' END AS failed_rules FROM events""",
)
def quarantine_rows(m):
    """Stage rows separated by rule; both outputs, labelled. NULL keys are not bad by these rules."""
    kind, key = F.col("event_type"), _text("event_id")
    staged = m.table("events").select(
        F.when(kind == "error", F.concat(key, F.lit("|"), _text("user_id")))
        .when(kind == "signup", F.concat(key, F.lit("junk")))
        .when(kind != "view", key)
        .alias("event_key"),
        "value",
    )
    good, bad = split_valid(staged, bad_key_rules("event_key"))
    return good.withColumn("failed_rules", F.lit("")).unionByName(
        bad.withColumnRenamed("_failed_rules", "failed_rules")
    )


@query(
    "active_only",
    "SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS preferences, false AS is_deleted FROM customer WHERE c_acctbal >= 0",
)
def active_rows(m):
    marked = soft_delete(m.customers(), m.customer_deletes(), "customer_id")
    return active_only(marked).drop("delete_reason", "delete_timestamp")


@query(
    "mask_customer",
    """SELECT c_custkey AS customer_id, c_name AS name, '** PII **' AS mobile, '** EMAIL **' AS email,
       CASE WHEN c_acctbal > 0 THEN 'Google' END AS login_by_using, '** PII **' AS gender, '** PII **' AS dob FROM customer""",
)
def mask_customer(m):
    """Tags come from the silver schema; NULLs are masked too."""
    silver = _silver(en.CUSTOMER, raw_customer(m))
    return mask(silver).select("customer_id", "name", "mobile", "email", "login_by_using", "gender", "dob")

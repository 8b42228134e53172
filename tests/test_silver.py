from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import CSV, OPENED, ORDERED, drop_file, rows, ts
from tiffinlake.functions import casting, geography, rules
from tiffinlake.functions.fixed_values import STATE_CODES
from tiffinlake.operators.masking import mask, tags_of, with_tags
from tiffinlake.operators.quarantine import bad_key_rules, split_valid
from tiffinlake.plans import entities as en
from tiffinlake.plans.silver import to_silver
from tiffinlake.sources.raw import read_raw


def silver(spark, tmp_path, name, lines=None):
    entity = en.ENTITIES[name]
    folder = drop_file(tmp_path / name, entity, lines or CSV[name][:1])
    return to_silver(read_raw(spark, folder, entity.raw_columns, "2023-01-15"), entity)


def one(df, entity):
    return df.select(*entity.columns).collect()[0].asDict()


def test_customer(spark, tmp_path):
    row = one(silver(spark, tmp_path, "customer"), en.CUSTOMER)
    assert row == {
        "customer_id": 7,
        "name": "Koskinen, Anneli",
        "mobile": "0401112223",
        "email": "anneli@example.org",
        "login_by_using": "OTP",
        "gender": "Female",
        "dob": date(1988, 11, 30),
        "anniversary": None,
        "preferences": '{"diet":"vegan","spice":2}',
        "created_dt": ts(OPENED),
        "modified_dt": ts(OPENED),
    }


def test_address_keeps_null_and_coordinates(spark, tmp_path):
    row = one(silver(spark, tmp_path, "customeraddress"), en.CUSTOMER_ADDRESS)
    assert (row["address_id"], row["customer_id_fk"], row["house_no"]) == (70, 7, None)
    assert (row["coordinates"], row["state"], row["pincode"]) == ("13.0067|80.2206", "Tamil Nadu", "600020")


def test_location_is_enriched(spark, tmp_path):
    row = silver(spark, tmp_path, "location").collect()[0]
    assert (row.location_id, row.state_code, row.is_union_territory, row.capital_city_flag, row.city_tier) == (
        12, "TN", False, True, "Tier-1",
    )
    assert (row.zip_code, row.active_flag, row.created_ts) == ("600001", "Y", ts(OPENED))


def test_restaurant_menu_agent(spark, tmp_path):
    restaurant = one(silver(spark, tmp_path, "restaurant"), en.RESTAURANT)
    assert restaurant["pricing_for_two"] == Decimal("450.00")
    assert (restaurant["latitude"], restaurant["longitude"]) == (Decimal("13.033900"), Decimal("80.261900"))
    assert restaurant["cuisine_type"] == "South Indian|Vegan"
    menu = one(silver(spark, tmp_path, "menu"), en.MENU)
    assert (menu["price"], menu["availability"], menu["restaurant_id_fk"]) == (Decimal("89.50"), True, 5)
    agent = one(silver(spark, tmp_path, "deliveryagent"), en.DELIVERY_AGENT)
    assert (agent["rating"], agent["location_id_fk"]) == (Decimal("4.25"), 12)


def test_transactions(spark, tmp_path):
    order = one(silver(spark, tmp_path, "orders"), en.ORDERS)
    assert (order["order_id"], order["total_amount"], order["order_date"]) == (900, Decimal("268.50"), ts(ORDERED))
    item = one(silver(spark, tmp_path, "order_item"), en.ORDER_ITEM)
    assert (item["quantity"], item["price"], item["subtotal"]) == (Decimal("3.00"), Decimal("89.50"), Decimal("268.50"))
    delivery = one(silver(spark, tmp_path, "delivery"), en.DELIVERY)
    assert (delivery["delivery_status"], delivery["estimated_time"]) == ("Delivered", "35 minutes")


def test_fractions_survive(spark, tmp_path):
    line = f"1,2,3,{ORDERED},99.95,Completed,Cash,{ORDERED},{ORDERED}"
    assert one(silver(spark, tmp_path, "orders", [line]), en.ORDERS)["total_amount"] == Decimal("99.95")


def test_strict_mode_fails_on_bad_text(spark):
    entity = en.ORDER_ITEM
    raw = spark.createDataFrame(
        [("x", "1", "1", "1", "1", "1", ORDERED, ORDERED)], entity.raw_columns
    )
    assert to_silver(raw, entity).collect()[0].order_item_id is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        to_silver(raw, entity, strict=True).collect()


def test_alternative_raw_name_and_processing_time(spark):
    raw = spark.createDataFrame(
        [("12", "Chennai", "Tamil Nadu", "1", "inactive", OPENED, None)],
        "locationid string, city string, state string, zipcode string, activeflag string, createdate string, modifieddate string",
    )
    row = to_silver(raw, en.LOCATION, batch_ts="2024-01-01 00:00:00").collect()[0]
    assert row.created_ts == ts(OPENED) and row.active_flag == "N"
    assert row._silver_processed_dt == ts("2024-01-01")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("12", 12), ("+12", 12), ("-12", -12), (" 12 ", 12), ("12.7", None), ("abc", None), ("", None),
        ("99999999999999999999", None), (None, None),
    ],
)
def test_tolerant_integer(spark, text, expected):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(casting.cast_text(F.col("c"), "bigint")).collect()[0][0] == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2023-01-10T09:30:45", "2023-01-10T09:30:45"),
        ("2023-01-10 09:30:45.123456789", "2023-01-10T09:30:45.123456"),
        ("2023-01-10T09:30:45.5", "2023-01-10T09:30:45.500000"),
        ("2023-01-10T09:30:45Z", "2023-01-10T09:30:45"),
        ("2023-01-10 09:30:45 +05:30", "2023-01-10T04:00:45"),
        ("2023-01-10", "2023-01-10T00:00:00"),
        ("2023-02-30", None),
        ("12:30", None),
        ("2023", None),
        ("yesterday", None),
        (None, None),
    ],
)
def test_tolerant_timestamp(spark, text, expected):
    df = spark.createDataFrame([(text,)], "c string")
    value = df.select(casting.parse_timestamp(F.col("c"))).collect()[0][0]
    assert value == (ts(expected) if expected else None)


def test_timestamp_with_own_formats(spark):
    df = spark.createDataFrame([("10/01/2023",), ("20230110",), ("x",)], "c string")
    parsed = casting.parse_timestamp(F.col("c"), ["dd/MM/yyyy", "yyyyMMdd"])
    assert [r[0] for r in df.select(parsed).collect()] == [ts("2023-01-10"), ts("2023-01-10"), None]


def test_geography_rules(spark):
    df = spark.createDataFrame(
        [("Delhi", "New Delhi"), ("Karnataka", "Bengaluru"), ("Goa", "Panaji"), ("Chandigarh", "Chandigarh"), (None, None)],
        "state string, city string",
    )
    got = rows(
        geography.enrich_location(df), "city", "state", "state_code", "is_union_territory", "capital_city_flag", "city_tier"
    )
    assert got == sorted(
        [
            ("New Delhi", "New Delhi", "DL", True, True, "Tier-3"),
            ("Bengaluru", "Karnataka", "KA", False, True, "Tier-1"),
            ("Panaji", "Goa", "GA", False, False, "Tier-3"),
            ("Chandigarh", "Chandigarh", "CH", True, False, "Tier-2"),
            (None, None, None, False, False, "Tier-3"),
        ],
        key=repr,
    )
    assert len(STATE_CODES) == 25


def test_flags_and_fill(spark):
    df = spark.createDataFrame([("yes",), ("Inactive",), ("odd",), (None,)], "f string")
    got = [tuple(r) for r in df.select(
        rules.yes_no_flag(F.col("f")),
        rules.boolean_flag(F.col("f")),
        rules.boolean_flag(F.col("f"), default=True),
    ).collect()]
    assert got == [("Y", True, True), ("N", None, True), ("odd", None, True), (None, None, True)]
    filled = rules.fill_missing_text(spark.createDataFrame([(None, None)], "a string, b int")).collect()[0]
    assert (filled.a, filled.b) == ("N/A", None)


def test_quarantine_of_bad_files(spark):
    df = spark.createDataFrame([("1",), ("2|Delhi|Y",), ("junk",), ("junk|x",), (None,)], "locationid string")
    good, bad = split_valid(df, bad_key_rules("locationid"))
    assert rows(good) == [("1",), (None,)]
    assert rows(bad) == sorted(
        [("2|Delhi|Y", "wrong_delimiter"), ("junk", "junk"), ("junk|x", "wrong_delimiter,junk")], key=repr
    )


def test_masking_by_schema_tags(spark, tmp_path):
    df = silver(spark, tmp_path, "customer")
    assert tags_of(df) == {"mobile": "PII", "email": "EMAIL", "gender": "PII", "dob": "PII"}
    row = mask(df).collect()[0]
    assert (row.mobile, row.email, row.gender, row.dob, row.name) == (
        "** PII **", "** EMAIL **", "** PII **", "** PII **", "Koskinen, Anneli",
    )
    phones = with_tags(spark.createDataFrame([("1", None)], "a string, b string"), {"a": "SENSITIVE", "b": "PHONE"})
    assert tuple(mask(phones).collect()[0]) == ("1", "** Phone **")
    assert tuple(mask(phones, tokens={"SENSITIVE": "#"}).collect()[0]) == ("#", "** Phone **")

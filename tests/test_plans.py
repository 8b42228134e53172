"""What the plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from tiffinlake.functions.keys import packed_key, unpacked_key
from tiffinlake.operators.planning import is_light, is_small
from tiffinlake.operators.scd2 import apply_scd2
from tiffinlake.operators.upsert import upsert
from tiffinlake.plans import entities as en
from tiffinlake.plans import kpi, star


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def conf(spark):
    changed = []

    def set_(**values):
        for key, value in values.items():
            key = "spark.sql." + key.replace("__", ".")
            spark.conf.set(key, value)
            changed.append(key)

    yield set_
    for key in changed:
        spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def dim(spark, entity, n, **links):
    """A dimension of n current members whose foreign keys equal their own key."""
    return spark.range(0, n, 1, 2).select(
        F.sha2(F.col("id").cast("string"), 256).alias(entity.surrogate),
        F.col("id").alias(entity.keys[0]),
        *[F.col("id").alias(k) for k in links],
        F.lit("1970-01-01").cast("timestamp").alias(entity.start),
        F.lit(None).cast("timestamp").alias(entity.end),
        F.lit(True).alias(entity.flag),
    )


def test_hot_order_and_hot_customer_are_split(spark, conf):
    """A third of the items belong to one order and a third of the orders to one customer."""
    conf(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="200k",
        adaptive__advisoryPartitionSizeInBytes="100k",
        adaptive__coalescePartitions__enabled="false",
        shuffle__partitions="16",
    )
    hot = F.when(F.col("id") % 3 == 0, F.lit(7))
    items = spark.range(0, 300_000, 1, 8).select(
        F.col("id").alias("order_item_id"),
        hot.otherwise(F.col("id") % 60_000).cast("bigint").alias("order_id_fk"),
        (F.col("id") % 100).alias("menu_id_fk"),
        *[F.lit(1).cast("decimal(10,2)").alias(c) for c in star.MEASURES],
    )
    orders = spark.range(0, 60_000, 1, 8).select(
        F.col("id").alias("order_id"),
        hot.otherwise(F.col("id") % 6_000).cast("bigint").alias("customer_id_fk"),
        (F.col("id") % 100).alias("restaurant_id_fk"),
        F.timestamp_seconds(F.col("id") * 3600).alias("order_date"),
    )
    delivery = orders.select(
        F.col("order_id").alias("order_id_fk"),
        F.col("order_date").alias("modified_date"),
        F.col("order_id").alias("delivery_id"),
        (F.col("order_id") % 100).alias("delivery_agent_id_fk"),
        F.col("customer_id_fk").alias("customer_address_id_fk"),
        F.lit("Delivered").alias("delivery_status"),
        F.lit("30 minutes").alias("estimated_time"),
    )
    dims = {
        "location": dim(spark, en.LOCATION, 100),
        "restaurant": dim(spark, en.RESTAURANT, 100, location_id_fk=1),
        "customer": dim(spark, en.CUSTOMER, 6_000),
        "customeraddress": dim(spark, en.CUSTOMER_ADDRESS, 6_000, customer_id_fk=1),
        "menu": dim(spark, en.MENU, 100),
        "deliveryagent": dim(spark, en.DELIVERY_AGENT, 100),
        "date": star.date_dim(spark, "1970-01-01", "1977-01-01"),
    }
    fact = star.build_order_item_fact(items, orders, delivery, dims)
    # Uses every column, so that no lookup is pruned away.
    total = fact.agg(F.count(F.lit(1)), F.max(F.concat_ws("", *fact.columns)), F.count_if(star.unresolved()))
    n, _, unresolved = total.collect()[0]
    assert (n, unresolved) == (300_000, 0)
    skewed = re.findall(r"SortMergeJoin\(skew=true\) \[(\w+)#", plan_of(total))
    assert "order_id_fk" in skewed and "customer_id_fk" in skewed


def joins_of(df) -> list[tuple[str, str, str]]:
    """Condition and columns of either side of each join, as planned."""
    found, nodes = [], [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Join":
            found.append((node.condition().toString(), node.left().output().mkString(" "), node.right().output().mkString(" ")))
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_items_move_without_the_keys_of_their_order(spark, conf, threshold):
    """Large dimensions: the menu joins before any key is there. Small ones: no key is there when items meet orders."""
    from tiffinlake.sources.marketplace import Marketplace

    conf(autoBroadcastJoinThreshold=threshold)
    joins = joins_of(Marketplace(spark, "/root/testdata/sf0.001").build_fact())
    menu = [left for condition, left, _ in joins if "__menu_id" in condition]
    orders = [left + right for condition, left, right in joins if "header_order_id" in condition]
    assert len(menu) == len(orders) == 1
    if threshold == "-1":
        assert "_dim_key" not in menu[0]
    else:
        assert "_dim_key" not in orders[0]


def test_packed_keys_come_back(spark):
    digest = "0a" * 32
    texts = [digest, digest.upper(), digest[:-1], digest + "\n", "", "r1", "\x00", "ключ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "k string")
    back = rows.select("k", packed_key("k").alias("p")).select("k", F.length("p").alias("n"), unpacked_key("p").alias("back")).collect()
    assert all(r.back == r.k for r in back)
    assert [r.n for r in back if r.k == digest] == [33]


def test_items_move_once_however_many_dimensions(spark):
    """With small dimensions the only shuffles are those on the order id."""
    from tiffinlake.sources.marketplace import Marketplace

    m = Marketplace(spark, "/root/testdata/sf0.001")
    plan = plan_of(m.build_fact())
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert set(exchanges) <= {"order_item_id", "order_id_fk", "order_id", "header_order_id", "l_orderkey"}
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_kpi_reads_few_columns_and_pushes_the_status(spark, tmp_path):
    path = str(tmp_path / "fact")
    spark.range(10).select(
        F.col("id").alias("order_item_id"), F.col("id").alias("order_id"), F.lit("d").alias("order_date_dim_key"),
        F.lit("r").alias("restaurant_dim_key"), F.lit("m").alias("menu_dim_key"),
        F.lit(1).cast("decimal(10,2)").alias("subtotal"), F.lit("Delivered").alias("delivery_status"),
    ).write.parquet(path)
    plan = plan_of(kpi.revenue_kpi(spark.read.parquet(path), star.date_dim(spark, "2023-01-01", "2023-12-31"), "month"))
    assert "EqualTo(delivery_status,Delivered)" in plan
    assert "menu_dim_key" not in plan and "restaurant_dim_key" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "BroadcastHashJoin" in plan


def test_a_small_batch_never_shuffles_the_table(spark, tmp_path):
    spark.range(0, 5_000, 1, 4).select(
        F.col("id").alias("k"), F.lit("x").alias("v"), F.lit("unused").alias("w")
    ).write.parquet(str(tmp_path / "t"))
    spark.range(10).select(F.col("id").alias("k"), F.lit("y").alias("v")).write.parquet(str(tmp_path / "b"))
    target, batch = spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "b"))
    assert is_small(batch)
    plan = plan_of(upsert(target, batch, "k"))
    joins = re.findall(r"BroadcastHashJoin \[[^\]]*\], \[[^\]]*\], (\w+)", plan)
    assert {"LeftSemi", "LeftAnti"} <= set(joins)
    # The untouched rows come straight from the scan.
    anti = plan[plan.index("LeftAnti") :]
    assert "Exchange hashpartitioning" not in anti


def test_history_passes_by_the_dimension_join(spark, tmp_path):
    """Expired versions are read and passed on; only current ones meet the batch."""
    source = spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    apply_scd2(source, None, "k", "hk", ["v"], "2024-01-01").write.parquet(str(tmp_path / "d"))
    after = apply_scd2(source, spark.read.parquet(str(tmp_path / "d")), "k", "hk", ["v"], "2024-02-01")
    plan = plan_of(after)
    assert plan.lstrip().startswith(("AdaptiveSparkPlan", "Union")) and "Union" in plan
    assert plan.count("SortMergeJoin") == 1
    assert "EqualTo(is_current,true)" in plan


def test_without_hot_keys_a_replay_is_one_scan_and_no_join(spark, tmp_path):
    """The branches for hot keys disappear at run time when there are none."""
    from tiffinlake.operators.timeline import scd2_history

    path = str(tmp_path / "events")
    spark.range(0, 2_000, 1, 4).select(
        (F.col("id") % 50).alias("k"), F.timestamp_seconds("id").alias("at"), (F.col("id") % 3).alias("v")
    ).write.parquet(path)
    history = scd2_history(spark.read.parquet(path), "k", ["v"], "at", distinct_times=True)
    history.collect()
    final = plan_of(history).split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final
    assert final.count("FileScan") == 1 and "HashJoin" not in final and final.count("Exchange hashpartitioning") == 1


def test_dimensions_small_as_files_only_are_not_broadcast(spark, tmp_path):
    """Digests are computed from a narrow table: as rows they are many times what its files hold."""
    ids = spark.range(150_000)
    ids.coalesce(1).write.parquet(str(tmp_path / "ids"))
    few = spark.read.parquet(str(tmp_path / "ids"))

    def dim(entity, rows):
        columns = {c: F.col("id") for c in entity.keys} | {"customer_id_fk": F.col("id"), "location_id_fk": F.lit(1)}
        return rows.select(
            F.sha2(F.col("id").cast("string"), 256).alias(entity.surrogate), *[c.alias(n) for n, c in columns.items()],
            F.lit(True).alias(entity.flag),
        )

    large = {"menu", "customer"}
    dims = {e.name: dim(e, few if e.name in large else few.filter("id < 20").localCheckpoint()) for e in en.DIMENSIONS}
    dims["date"] = star.date_dim(spark, "2023-01-01", "2023-01-31")
    placed = F.lit("2023-01-05").cast("timestamp")
    orders = few.select(F.col("id").alias("order_id"), F.col("id").alias("customer_id_fk"), (F.col("id") % 20).alias("restaurant_id_fk"), placed.alias("order_date"))
    deliveries = few.select(
        F.col("id").alias("delivery_id"), F.col("id").alias("order_id_fk"), (F.col("id") % 20).alias("delivery_agent_id_fk"),
        F.col("id").alias("customer_address_id_fk"), placed.alias("modified_date"), F.lit("Delivered").alias("delivery_status"),
        F.lit("1").alias("estimated_time"),
    )
    measures = [F.lit(1).cast("decimal(10,2)").alias(c) for c in star.MEASURES]
    items = few.select(F.col("id").alias("order_item_id"), F.col("id").alias("order_id_fk"), F.col("id").alias("menu_id_fk"), *measures)
    assert is_small(dims["menu"]) and is_light(dims["menu"].limit(10)) and not is_light(few.withColumn("k", packed_key(F.lit("k"))))
    wanted = ["order_id", "customer_dim_key", "restaurant_dim_key", "menu_dim_key"]
    for how in ("left", "inner"):
        for columns in (wanted, ["order_id"]):  # keys alone are smaller still
            fact = star.build_order_item_fact(items, orders, deliveries, dims, how=how).select(*columns)
            joins = re.findall(r"(SortMergeJoin|BroadcastHashJoin) \[([a-z_]+)#\w+\], \[(\w+)#", plan_of(fact))
            kinds = {right: kind for kind, _, right in joins if right.startswith("__")}
            assert kinds["__menu_id"] == kinds["__customer_id"] == "SortMergeJoin"
            assert kinds["__restaurant_id"] == "BroadcastHashJoin"
        full = star.build_order_item_fact(items, orders, deliveries, dims, how=how)
        assert full.count() == (150_000 if how == "left" else 20)
        assert full.filter("menu_dim_key <> sha2(string(order_item_id), 256) OR customer_dim_key <> sha2(string(order_id), 256)").isEmpty()

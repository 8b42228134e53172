"""The generic retail tables read as food-delivery entities.

Customers order at suppliers ("restaurants") from parts ("menu items"). This is the only module
that knows the retail column names; everything downstream sees the warehouse's own entities.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv
from ..operators.dedup import latest_per_key
from ..operators.scd2 import initial_scd2
from ..plans import entities as en
from ..plans import star
from . import files, tables

# The two batch times of the examples: before all orders, and after them.
FIRST_LOAD, SECOND_LOAD = "1995-01-01 00:00:00", "2002-01-01 00:00:00"
# Keys of customers that first appear in the second batch start here, above any customer key.
NEW_CUSTOMER_BASE = 1_000_000_000_000_000

DIM_TRACKING = {
    "location": ["city", "state", "zip_code"],
    "restaurant": ["name", "location_id_fk", "pricing_for_two"],
    "customer": ["name", "preferences"],
    "customeraddress": ["customer_id_fk", "city"],
    "menu": ["item_name", "category", "price"],
    "deliveryagent": ["name", "location_id_fk"],
}

_stored: dict[tuple[str, str, str], str] = {}


def money(c: str) -> Column:
    return F.col(c).cast("decimal(10,2)")


def delivery_status(c: str = "o_orderstatus") -> Column:
    return (
        F.when(F.col(c) == "F", F.lit(fv.DELIVERED))
        .when(F.col(c) == "O", F.lit("In Transit"))
        .otherwise(F.lit("Pending"))
    )


class Marketplace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        # Opening a table reads file footers, so each is opened once.
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    # Entities, typed as in silver.

    def locations(self) -> DataFrame:
        nation, region = self.table("nation").alias("n"), self.table("region").alias("r")
        return nation.join(region, F.expr("n.n_regionkey = r.r_regionkey")).select(
            F.col("n_nationkey").cast("bigint").alias("location_id"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("state"),
            (F.col("n_nationkey") + 560000).cast("string").alias("zip_code"),
        )

    def restaurants(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("restaurant_id"),
            F.col("s_name").alias("name"),
            F.col("s_nationkey").cast("bigint").alias("location_id_fk"),
            money("s_acctbal").alias("pricing_for_two"),
        )

    def agents(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("delivery_agent_id"),
            F.col("s_name").alias("name"),
            F.col("s_nationkey").cast("bigint").alias("location_id_fk"),
        )

    def customers(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("preferences"),
        )

    def customers_next(self) -> DataFrame:
        """The next full delivery of customers.

        Accounts in debt are gone, accounts above 5000 are premium, suppliers open accounts.
        """
        kept = self.table("customer").filter(F.col("c_acctbal") >= 0).select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("name"),
            F.when(F.col("c_acctbal") >= 5000, F.lit("PREMIUM"))
            .otherwise(F.col("c_mktsegment"))
            .alias("preferences"),
        )
        opened = self.table("supplier").select(
            (F.col("s_suppkey") + NEW_CUSTOMER_BASE).alias("customer_id"),
            F.col("s_name").alias("name"),
            F.lit("SUPPLIER").alias("preferences"),
        )
        return kept.unionByName(opened)

    def customer_deletes(self) -> DataFrame:
        """Delete requests for the accounts in debt."""
        return self.table("customer").filter(F.col("c_acctbal") < 0).select(
            F.col("c_custkey").alias("customer_id"),
            F.lit("Account closed").alias("delete_reason"),
            F.lit("2001-06-01 12:00:00").cast("timestamp").alias("delete_timestamp"),
        )

    def addresses(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("address_id"),
            F.col("c_custkey").alias("customer_id_fk"),
            F.col("c_nationkey").cast("string").alias("city"),
        )

    def menu(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("menu_id"),
            F.col("p_name").alias("item_name"),
            F.col("p_type").alias("category"),
            money("p_retailprice").alias("price"),
        )

    def build_order_heads(self) -> DataFrame:
        """Orders with the first supplier among their lines, at which they are placed."""
        supplier = self.table("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("supplier"))
        heads = self.table("orders").join(supplier, F.expr("o_orderkey = l_orderkey"), "left")
        return heads.select(
            "o_orderkey", "o_custkey", "supplier", "o_orderdate", money("o_totalprice").alias("total_amount"),
            "o_orderstatus", "o_orderpriority",
        )

    def order_heads(self) -> DataFrame:
        return self.stored("order-heads", self.build_order_heads)

    def order_lines(self) -> DataFrame:
        """Lines as delivered: a line number of an order may occur several times."""
        subtotal = F.col("l_extendedprice").cast("decimal(12,2)") * (
            F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
        )
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_item_id"),
            F.col("l_orderkey").alias("order_id_fk"),
            F.col("l_partkey").alias("menu_id_fk"),
            money("l_quantity").alias("quantity"),
            money("l_extendedprice").alias("price"),
            subtotal.cast("decimal(10,2)").alias("subtotal"),
            F.col("l_shipdate").cast("timestamp").alias("modified_dt"),
        )

    def build_order_items(self) -> DataFrame:
        """The latest delivery of each line."""
        return latest_per_key(self.order_lines(), ["order_item_id", "order_id_fk"], "modified_dt")

    # The sales tables as stored in silver.

    def orders(self) -> DataFrame:
        ordered = F.col("o_orderdate").cast("timestamp")
        return self.order_heads().select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id_fk"),
            F.col("supplier").alias("restaurant_id_fk"),
            ordered.alias("order_date"),
            "total_amount",
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("payment_method"),
            ordered.alias("modified_dt"),
        )

    def deliveries(self) -> DataFrame:
        ordered = F.col("o_orderdate").cast("timestamp")
        return self.order_heads().select(
            F.col("o_orderkey").alias("delivery_id"),
            F.col("o_orderkey").alias("order_id_fk"),
            F.col("supplier").alias("delivery_agent_id_fk"),
            delivery_status().alias("delivery_status"),
            F.col("o_orderpriority").alias("estimated_time"),
            F.col("o_custkey").alias("customer_address_id_fk"),
            ordered.alias("modified_date"),
        )

    def order_items(self) -> DataFrame:
        return self.stored("order-items", self.build_order_items)

    # Gold.

    def dimension(self, entity: en.Entity, rows: DataFrame) -> DataFrame:
        return initial_scd2(
            rows, entity.keys, entity.surrogate, DIM_TRACKING[entity.name], FIRST_LOAD,
            entity.start, entity.end, entity.flag,
        )

    def customer_dim(self) -> DataFrame:
        return self.dimension(en.CUSTOMER, self.customers())

    def restaurant_dim(self) -> DataFrame:
        return self.dimension(en.RESTAURANT, self.restaurants())

    def date_dim(self) -> DataFrame:
        return star.date_dim_of(self.table("orders"), "o_orderdate")

    def dims(self) -> dict[str, DataFrame]:
        return {
            "location": self.dimension(en.LOCATION, self.locations()),
            "restaurant": self.restaurant_dim(),
            "customer": self.customer_dim(),
            "customeraddress": self.dimension(en.CUSTOMER_ADDRESS, self.addresses()),
            "menu": self.dimension(en.MENU, self.menu()),
            "deliveryagent": self.dimension(en.DELIVERY_AGENT, self.agents()),
            "date": self.date_dim(),
        }

    def build_fact(self, **options) -> DataFrame:
        return star.build_order_item_fact(
            self.order_items(), self.orders(), self.deliveries(), self.dims(), **options
        )

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived table as its readers find it: built and written once per session.

        What building it shuffles is freed once it is written.
        """
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _stored or not files.exists(self.spark, _stored[key]):
            path = files.shared_folder(self.spark, name)
            with tables.scratch(self.spark):
                build().write.option("compression", "zstd").parquet(path)
            _stored[key] = path
        return self.spark.read.parquet(_stored[key])

    @cached_property
    def fact(self) -> DataFrame:
        """Not stored: its rows are many times wider than what a reader takes of them, and what none takes isn't moved."""
        return self.build_fact()

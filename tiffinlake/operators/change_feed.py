"""Row-level changes between two states of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import as_list, keys_equal, row_struct

ACTION, IS_UPDATE = "action", "is_update"


def change_feed(before: DataFrame, after: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """What a standard table stream reports between two snapshots.

    Insert: (INSERT, false). Update: old row as (DELETE, true) and new row as (INSERT, true).
    Delete: (DELETE, false). Rows equal in both snapshots give nothing. One full outer join, each
    side shuffled once; keys must be unique and not NULL in each snapshot.
    """
    keys = as_list(keys)
    columns = before.columns
    b = before.select(row_struct(columns).alias("row"), *keys).alias("b")
    a = after.select(*columns).select(row_struct(columns).alias("row"), *keys).alias("a")
    joined = b.join(a, keys_equal(keys, "b", "a"), "full_outer").filter(
        ~F.col("b.row").eqNullSafe(F.col("a.row"))
    )
    is_update = F.col("b.row").isNotNull() & F.col("a.row").isNotNull()

    def event(side: str, action: str):
        row = F.struct(
            F.col(f"{side}.row").alias("row"),
            F.lit(action).alias(ACTION),
            is_update.alias(IS_UPDATE),
        )
        return F.when(F.col(f"{side}.row").isNotNull(), row)

    events = joined.select(
        F.explode(F.array_compact(F.array(event("b", "DELETE"), event("a", "INSERT")))).alias("e")
    )
    return events.select("e.row.*", f"e.{ACTION}", f"e.{IS_UPDATE}")


def version_diff(a: DataFrame, b: DataFrame, label_a: str = "1", label_b: str = "2") -> DataFrame:
    """Rows found in one version only, labelled, as sets.

    One aggregate over both versions answers both directions of EXCEPT with a single shuffle, and
    copies of a row are folded before it.
    """
    columns = a.columns
    tagged = a.withColumn("__in_a", F.lit(True)).unionByName(
        b.select(*columns).withColumn("__in_a", F.lit(False))
    )
    sides = tagged.groupBy(*columns).agg(
        F.bool_or("__in_a").alias("__any_a"), F.bool_and("__in_a").alias("__only_a")
    )
    only_a, only_b = F.col("__only_a"), ~F.col("__any_a")
    return sides.filter(only_a | only_b).select(
        F.when(only_a, F.lit(f"Only in Version {label_a}"))
        .otherwise(F.lit(f"Only in Version {label_b}"))
        .alias("diff_type"),
        *columns,
    )

"""Logical and physical deletes driven by a delete feed (key, delete_reason, delete_timestamp)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import as_list, hash_key, instant, keys_equal

IS_DELETED, REASON, DELETED_AT = "is_deleted", "delete_reason", "delete_timestamp"


def first_request(deletes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One request per key, the earliest: later requests for the same key have nothing to delete."""
    earliest = F.min(F.struct(F.col(DELETED_AT).cast("timestamp").alias(DELETED_AT), F.col(REASON)))
    return (
        deletes.groupBy(*keys)
        .agg(earliest.alias("d"))
        .select(*keys, f"d.{REASON}", f"d.{DELETED_AT}")
    )


def soft_delete(
    df: DataFrame,
    deletes: DataFrame,
    key: str | Sequence[str],
    status_column: str | None = None,
    status_value: str | None = None,
) -> DataFrame:
    """Marks rows as deleted with reason and time, and may move a status column (e.g. to Returned)."""
    keys = as_list(key)
    t = df.alias("t")
    d = first_request(deletes, keys).withColumn("__hit", F.lit(True)).alias("d")
    joined = t.join(d, keys_equal(keys, "t", "d"), "left")
    hit = F.col("d.__hit").isNotNull()

    def old(c: str, data_type: str) -> Column:
        return F.col(f"t.{c}") if c in df.columns else F.lit(None).cast(data_type)

    already = F.coalesce(old(IS_DELETED, "boolean"), F.lit(False))
    fresh = hit & ~already
    marks = {
        IS_DELETED: already | hit,
        REASON: F.when(fresh, F.col(f"d.{REASON}")).otherwise(old(REASON, "string")),
        DELETED_AT: F.when(fresh, F.col(f"d.{DELETED_AT}")).otherwise(old(DELETED_AT, "timestamp")),
    }
    if status_column:
        marks[status_column] = F.when(fresh, F.lit(status_value)).otherwise(F.col(f"t.{status_column}"))
    columns = list(dict.fromkeys([*df.columns, IS_DELETED, REASON, DELETED_AT]))
    return joined.select(*[marks.get(c, F.col(f"t.`{c}`")).alias(c) for c in columns])


def active_only(df: DataFrame) -> DataFrame:
    """Rows not logically deleted. A table without the flag has no deleted rows."""
    if IS_DELETED not in df.columns:
        return df
    return df.filter(~F.coalesce(F.col(IS_DELETED), F.lit(False)))


def hard_delete(
    df: DataFrame,
    deletes: DataFrame,
    key: str | Sequence[str],
    table_name: str,
    deleted_by: str = "System",
) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, audit rows). The audit names the keys that were removed, not their data."""
    keys = as_list(key)
    requests = first_request(deletes, keys)
    kept = df.alias("t").join(requests.alias("d"), keys_equal(keys, "t", "d"), "left_anti")
    # Look up the table's keys in the (usually few) requests, not the other way round: the small
    # side can then be broadcast and a hot key folds to one row before anything moves.
    present = (
        df.select(*keys).alias("t")
        .join(requests.alias("d"), keys_equal(keys, "t", "d"), "left_semi")
        .distinct()
    )
    removed = requests.alias("d").join(present.alias("p"), keys_equal(keys, "d", "p"), "left_semi")
    key_text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    audit = removed.select(
        hash_key(F.lit(table_name), key_text, instant(DELETED_AT)).alias("deletion_audit_id"),
        F.lit(table_name).alias("table_name"),
        key_text.alias("primary_key_value"),
        F.col(REASON),
        F.col(DELETED_AT),
        F.lit(deleted_by).alias("deleted_by"),
    )
    return kept, audit


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """SQL ``DELETE ... WHERE``: a row goes only where the predicate is true, NULL keeps it."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))

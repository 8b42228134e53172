"""Slowly changing dimensions of type 2: every change of a tracked attribute is a new version.

A version is valid on the half-open interval [start, end); the current one has no end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import as_list, as_timestamp, hash_key, instant, keys_equal, same_values
from .change_feed import ACTION
from .dedup import latest_per_key
from .deletes import DELETED_AT, IS_DELETED, REASON, first_request
from .planning import split_touched, union_all

START, END, CURRENT = "eff_start_date", "eff_end_date", "is_current"
NEW, CHANGED, UNCHANGED, MISSING = "NEW", "CHANGED", "UNCHANGED", "MISSING"


def version_key(natural_key: Sequence[str], tracking: Sequence[str], start: str) -> Column:
    """Surrogate key of a version: who, with what attributes, since when."""
    return hash_key(*natural_key, *tracking, instant(start))


def _current(dim: DataFrame, flag: str) -> DataFrame:
    return dim.filter(F.col(flag))


def _history(dim: DataFrame, flag: str) -> DataFrame:
    return dim.filter(~F.coalesce(F.col(flag), F.lit(False)))


def initial_scd2(
    source: DataFrame,
    natural_key: str | Sequence[str],
    surrogate_key: str,
    tracking_columns: Sequence[str],
    batch_ts,
    start: str = START,
    end: str = END,
    flag: str = CURRENT,
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """First load: one current version per key."""
    keys, tracking = as_list(natural_key), list(tracking_columns)
    if order_by is not None:
        source = latest_per_key(source, keys, order_by)
    return source.withColumn(start, as_timestamp(batch_ts)).select(
        version_key(keys, tracking, start).alias(surrogate_key),
        *keys,
        *tracking,
        start,
        F.lit(None).cast("timestamp").alias(end),
        F.lit(True).alias(flag),
    )


def apply_scd2(
    source: DataFrame,
    dim: DataFrame | None,
    natural_key: str | Sequence[str],
    surrogate_key: str,
    tracking_columns: Sequence[str],
    batch_ts,
    start: str = START,
    end: str = END,
    flag: str = CURRENT,
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """The whole dimension after one batch.

    New keys open a version, changed keys close theirs at ``batch_ts`` and open the next, all other
    rows stay. A current key absent from the batch stays current: deletes come as deletes. A key
    whose last version was closed counts as new again. ``batch_ts`` may be a column of the batch,
    such as its modification time. A row that is not newer than the start of its key's current version
    changes nothing, so late and repeated batches never turn an interval round; to put late rows in
    their place replay all of them (``scd2_history``). With ``order_by`` the latest row per key is taken first;
    without it the batch must have unique keys.

    Only current rows meet the batch, in one full outer join; expired history passes through, and
    with a small batch so do all current rows of other keys.
    """
    keys, tracking = as_list(natural_key), list(tracking_columns)
    if order_by is not None:
        source = latest_per_key(source, keys, order_by)
    if dim is None:
        return initial_scd2(source, keys, surrogate_key, tracking, batch_ts, start, end, flag)

    batch = source.select(*keys, *tracking, as_timestamp(batch_ts).alias("__ts"))
    touched, untouched = split_touched(_current(dim, flag), batch, keys)
    d = touched.withColumn("__in", F.lit(True)).alias("d")
    s = batch.withColumn("__in", F.lit(True)).alias("s")
    joined = d.join(s, keys_equal(keys, "d", "s"), "full_outer")
    in_dim, in_batch = F.col("d.__in").isNotNull(), F.col("s.__in").isNotNull()
    newer = F.coalesce(F.col("s.__ts") > F.col(f"d.`{start}`"), F.lit(True))
    changed = in_dim & in_batch & newer & ~same_values(tracking, "d", "s")

    def closed(c: str) -> Column:
        if c == end:
            return F.when(changed, F.col("s.__ts")).otherwise(F.col(f"d.{end}"))
        if c == flag:
            return ~changed
        return F.col(f"d.`{c}`")

    def opened(c: str, data_type) -> Column:
        if c == surrogate_key:
            return hash_key(*[F.col(f"s.`{k}`") for k in [*keys, *tracking]], instant("s.__ts"))
        if c in keys or c in tracking:
            return F.col(f"s.`{c}`")
        if c == start:
            return F.col("s.__ts")
        if c == flag:
            return F.lit(True)
        if c == IS_DELETED:
            return F.lit(False)
        return F.lit(None).cast(data_type)

    old = F.struct(*[closed(c).cast(t).alias(c) for c, t in _types(dim)])
    new = F.struct(*[opened(c, t).cast(t).alias(c) for c, t in _types(dim)])
    versions = joined.select(
        F.explode(
            F.array_compact(F.array(F.when(in_dim, old), F.when(in_batch & (~in_dim | changed), new)))
        ).alias("v")
    ).select("v.*")
    return union_all(_history(dim, flag), untouched, versions)


def _types(df: DataFrame):
    return [(f.name, f.dataType) for f in df.schema]


def classify(
    source: DataFrame,
    dim: DataFrame,
    natural_key: str | Sequence[str],
    tracking_columns: Sequence[str],
    flag: str = CURRENT,
) -> DataFrame:
    """Per key: NEW, CHANGED, UNCHANGED, or MISSING from the batch."""
    keys, tracking = as_list(natural_key), list(tracking_columns)
    d = _current(dim, flag).select(*keys, *tracking).withColumn("__in", F.lit(True)).alias("d")
    s = source.select(*keys, *tracking).withColumn("__in", F.lit(True)).alias("s")
    status = (
        F.when(F.col("d.__in").isNull(), F.lit(NEW))
        .when(F.col("s.__in").isNull(), F.lit(MISSING))
        .when(same_values(tracking, "d", "s"), F.lit(UNCHANGED))
        .otherwise(F.lit(CHANGED))
    )
    return d.join(s, keys_equal(keys, "d", "s"), "full_outer").select(
        *[F.coalesce(F.col(f"d.`{k}`"), F.col(f"s.`{k}`")).alias(k) for k in keys],
        status.alias("status"),
    )


def changed_rows(
    source: DataFrame,
    dim: DataFrame,
    natural_key: str | Sequence[str],
    tracking_columns: Sequence[str],
    flag: str = CURRENT,
) -> DataFrame:
    """Batch rows whose current version differs."""
    keys, tracking = as_list(natural_key), list(tracking_columns)
    s, d = source.alias("s"), _current(dim, flag).alias("d")
    differs = keys_equal(keys, "s", "d") & ~same_values(tracking, "s", "d")
    return s.join(d, differs, "left_semi")


def new_rows(
    source: DataFrame, dim: DataFrame, natural_key: str | Sequence[str], flag: str = CURRENT
) -> DataFrame:
    """Batch rows whose key has no current version."""
    keys = as_list(natural_key)
    s, d = source.alias("s"), _current(dim, flag).select(*keys).alias("d")
    return s.join(d, keys_equal(keys, "s", "d"), "left_anti")


def match_all_attributes(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``left`` that have an identical row in ``right`` over ``columns``, NULL equal to NULL."""
    condition = None
    for c in columns:
        one = F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
        condition = one if condition is None else condition & one
    return left.alias("l").join(right.select(*columns).alias("r"), condition, "left_semi")


def apply_changes_scd2(
    dim: DataFrame | None,
    changes: DataFrame,
    natural_key: str | Sequence[str],
    surrogate_key: str,
    tracking_columns: Sequence[str],
    batch_ts,
    start: str = START,
    end: str = END,
    flag: str = CURRENT,
) -> DataFrame:
    """The whole dimension after a change feed.

    A DELETE row closes the current version that equals it in every attribute, NULL-safe. An INSERT
    row opens a version. An update is one of each, so nothing compares old with new.
    """
    keys, tracking = as_list(natural_key), list(tracking_columns)
    inserts = initial_scd2(
        changes.filter(F.col(ACTION) == "INSERT"), keys, surrogate_key, tracking, batch_ts, start, end, flag
    )
    if dim is None:
        return inserts
    attributes = [*keys, *tracking]
    removed = (
        changes.filter(F.col(ACTION) == "DELETE")
        .withColumn("__ts", as_timestamp(batch_ts))
        .groupBy(*attributes)
        .agg(F.min("__ts").alias("__ts"))
        .alias("x")
    )
    match = None
    for c in attributes:
        one = F.col(f"d.`{c}`").eqNullSafe(F.col(f"x.`{c}`"))
        match = one if match is None else match & one
    joined = _current(dim, flag).alias("d").join(removed, match, "left")
    gone = F.col("x.__ts").isNotNull()
    current = joined.select(
        *[
            F.when(gone, F.col("x.__ts")).otherwise(F.col(f"d.{c}")).alias(c)
            if c == end
            else (~gone).alias(c)
            if c == flag
            else F.col(f"d.`{c}`")
            for c in dim.columns
        ]
    )
    return union_all(_history(dim, flag), current, inserts)


def scd2_delete(
    dim: DataFrame,
    deletes: DataFrame,
    key: str | Sequence[str],
    end: str = END,
    flag: str = CURRENT,
) -> DataFrame:
    """Closes the current version of each deleted key at the time of the request.

    No new version is opened; the closed one carries ``is_deleted`` and the reason.
    """
    keys = as_list(key)
    dim = dim if IS_DELETED in dim.columns else dim.withColumn(IS_DELETED, F.lit(False))
    dim = dim if REASON in dim.columns else dim.withColumn(REASON, F.lit(None).cast("string"))
    requests = first_request(deletes, keys).alias("x")
    joined = _current(dim, flag).alias("d").join(requests, keys_equal(keys, "d", "x"), "left")
    gone = F.col(f"x.{DELETED_AT}").isNotNull()
    replaced = {
        end: F.when(gone, F.col(f"x.{DELETED_AT}")).otherwise(F.col(f"d.{end}")),
        flag: ~gone,
        IS_DELETED: gone | F.coalesce(F.col(f"d.{IS_DELETED}"), F.lit(False)),
        REASON: F.when(gone, F.col(f"x.{REASON}")).otherwise(F.col(f"d.{REASON}")),
    }
    current = joined.select(*[replaced.get(c, F.col(f"d.`{c}`")).alias(c) for c in dim.columns])
    return union_all(_history(dim, flag), current)


def scd2_metrics(
    dim: DataFrame, batch_ts, start: str = START, end: str = END, flag: str = CURRENT
) -> DataFrame:
    """How many versions a batch opened and closed. Compares with the batch's own timestamp."""
    ts = as_timestamp(batch_ts)
    return dim.agg(
        F.count_if((F.col(start) == ts) & F.col(flag)).alias("new_versions"),
        F.count_if((F.col(end) == ts) & ~F.col(flag)).alias("expired"),
    )

"""Choosing a plan shape from Catalyst's own size estimate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import keys_equal


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame) -> bool:
    """Whether Spark would broadcast this by itself. Only shapes plans; never forces a broadcast."""
    threshold = df._jdf.sparkSession().sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= estimated_bytes(df) <= threshold


def is_light(df: DataFrame) -> bool:
    """Whether the rows themselves, at the usual width of their types, stay within what Spark broadcasts.

    Its estimate starts from the size of files, and columns that compress well or are computed from few
    others are many times larger as rows. Counts them: meant for stored tables and projections of these.
    """
    threshold = df._jdf.sparkSession().sessionState().conf().autoBroadcastJoinThreshold()
    return df.count() * df._jdf.schema().defaultSize() <= threshold


#: What is broadcast beyond Spark's own limit holds at most so many bytes of rows as measured ...
BROADCAST_BYTES = 32 << 20
#: ... and saves a side from a shuffle that is by estimate at least so many times larger.
WORTH = 10


def is_worth_broadcasting(df: DataFrame, saved: DataFrame) -> bool:
    """Whether the rows, measured, are few and ``saved``, which needn't be shuffled then, is many times larger.

    Never where broadcasts are switched off. Reads ``df``: meant for stored tables and projections of these.
    """
    threshold = df._jdf.sparkSession().sessionState().conf().autoBroadcastJoinThreshold()
    most = min(BROADCAST_BYTES, estimated_bytes(saved) // WORTH)
    if threshold < 0 or estimated_bytes(df) > 4 * most:
        return False
    width = 8 * (1 + len(df.columns))
    if df.count() * width > most:
        return False
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return (df.agg(F.sum(sum(texts, F.lit(width)))).first()[0] or 0) <= most


def split_touched(
    target: DataFrame, source: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ``target`` whose key is in ``source``, all other rows).

    A daily batch is tiny next to its table. When it is small enough to broadcast, two map-side
    joins peel off the few affected rows and the rest of the table is never shuffled. Otherwise
    everything is returned as touched and the caller's full outer join shuffles both sides once.
    """
    if not is_small(source.select(*keys)):
        return target, None
    s = source.select(*keys).alias("s")
    t = target.alias("t")
    on = keys_equal(keys, "t", "s")
    return t.join(s, on, "left_semi"), t.join(s, on, "left_anti")


def union_all(first: DataFrame, *others: DataFrame | None) -> DataFrame:
    """Union by name; a column missing on one side is NULL there."""
    result = first
    for df in others:
        if df is not None:
            result = result.unionByName(df, allowMissingColumns=True)
    return result

"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import as_list


def latest_per_key(df: DataFrame, keys: str | Sequence[str], order_by: str | Sequence[str]) -> DataFrame:
    """The row with the greatest ``order_by`` values for each key; NULLs lose.

    The remaining columns break ties, so the choice never depends on row order. An aggregate does
    this where a ranking window would also work, because it combines on the map side: each task
    sends one row per key, however many copies a hot key has.
    """
    keys, order_by = as_list(keys), as_list(order_by)
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    best = F.max(F.struct(*[F.col(f"`{c}`") for c in [*order_by, *rest]])).alias("__best")
    picked = df.groupBy(*keys).agg(best)
    return picked.select(
        *[F.col(f"`{c}`") if c in keys else F.col(f"__best.`{c}`").alias(c) for c in df.columns]
    )

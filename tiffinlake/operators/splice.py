"""Late and out-of-order rows put in their place in a dimension of type 2.

A batch may hold rows older than versions that are already stored. Such a row cuts the version it falls
into; what follows may become a version, stop being one, or start earlier. Which of these holds depends on
every delivery of the key, also on those that once changed nothing: if A, again A and then, late, a B between
them arrive, the second A opens a version after all. Deliveries that opened no version are therefore kept in a
table of their own, the repeats; versions and repeats together are all that was ever delivered.

Only what a batch can touch is read into the replay: of the keys in it, the versions and repeats that are in
force at or after the key's earliest new row. Everything else passes through map-side, or is one shuffle when
the batch is too large for that. A closed version that no other follows was deleted; the delete is replayed
as an event of its own, so late rows fall before or after it, and a row after it opens the key again.

However the rows are cut into batches, and in whatever order these come, the outcome is that of replaying all
rows at once (``scd2_history``). Of several rows of a key at one instant the greatest by all tracked columns
counts. Rows without a key or time can't be placed and are returned by ``unplaceable``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import as_list, keys_equal
from ..sources.tables import stored
from .deletes import IS_DELETED, REASON
from .planning import is_small, union_all
from .scd2 import CURRENT, END, START, version_key
from .timeline import HOT_ROWS, HOT_SHARE, scd2_history

_GONE, _AT, _FIRST, _OVER = "__gone", "__at", "__first", "__over"


class Spliced(NamedTuple):
    """The dimension and the repeats after a batch."""

    dim: DataFrame
    repeats: DataFrame


def unplaceable(batch: DataFrame, keys: str | Sequence[str], ts: str) -> DataFrame:
    """Rows whose key or time is NULL."""
    missing = F.col(ts).isNull()
    for k in as_list(keys):
        missing = missing | F.col(f"`{k}`").isNull()
    return batch.filter(missing)


def _apart(df: DataFrame, since: DataFrame, keys: Sequence[str], over) -> tuple[DataFrame, DataFrame]:
    """(rows of the keys in ``since`` that ``over`` says may be touched, all others)."""
    plain = df.columns
    joined = df.alias("d").join(since.alias("s"), keys_equal(keys, "d", "s"), "left")
    hit = F.col(f"s.{_FIRST}").isNotNull() & F.coalesce(over, F.lit(True))
    marked = joined.select("d.*", hit.alias(_OVER))
    return marked.filter(F.col(_OVER)).select(*plain), marked.filter(~F.col(_OVER)).select(*plain)


def splice_scd2(
    batch: DataFrame,
    dim: DataFrame | None,
    repeats: DataFrame | None,
    natural_key: str | Sequence[str],
    surrogate_key: str,
    tracking_columns: Sequence[str],
    ts: str,
    start: str = START,
    end: str = END,
    flag: str = CURRENT,
    share: float = HOT_SHARE,
    min_rows: int = HOT_ROWS,
) -> Spliced:
    """The dimension and its repeats after a batch of rows that may be of any time.

    ``ts`` is the column of the batch that says since when a row holds. A key may come many times. Hot
    keys are cut along time, as in ``scd2_history``. ``repeats`` is None for a dimension that was never
    spliced; deliveries that changed nothing before that are unknown then.
    """
    keys, tracking = as_list(natural_key), list(tracking_columns)
    attributes = [*keys, *tracking]
    given = batch.dropna(subset=[*keys, ts]).select(*attributes, F.col(ts).cast("timestamp").alias(_AT)).distinct()
    given = stored(given, "splice-batch")
    deletes = dim is not None and IS_DELETED in dim.columns and REASON in dim.columns
    gone_type = "struct<is_deleted: boolean, delete_reason: string>"

    def events(rows: DataFrame, at: str) -> DataFrame:
        return rows.select(*attributes, F.lit(None).cast(gone_type).alias(_GONE), F.col(at).cast("timestamp").alias(_AT))

    parts, untouched_dim, untouched_repeats = [events(given, _AT)], None, None
    if dim is not None:
        since = given.groupBy(*keys).agg(F.min(_AT).alias(_FIRST))
        since = since if is_small(since) else stored(since, "splice-since")
        # A version that ended before the first new row, with another right after it, stays as it is.
        touched, untouched_dim = _apart(dim, since, keys, F.col(f"d.`{end}`") >= F.col(f"s.{_FIRST}"))
        touched = stored(touched, "splice-touched")
        reason = F.struct(
            (F.col(IS_DELETED) if deletes else F.lit(False)).alias("is_deleted"),
            (F.col(REASON) if deletes else F.lit(None)).cast("string").alias("delete_reason"),
        )
        ended = touched.filter(F.col(end).isNotNull()).select(
            *keys, *[F.lit(None).cast(touched.schema[c].dataType).alias(c) for c in tracking],
            reason.cast(gone_type).alias(_GONE), F.col(end).cast("timestamp").alias(_AT),
        )
        # An end at which another version starts is no delete.
        followed = touched.select(*keys, F.col(start).cast("timestamp").alias(_AT))
        ended = ended.join(followed, [*keys, _AT], "left_anti").select(*attributes, _GONE, _AT)
        # Nor is one at which the batch has a row: it holds from then on.
        ended = ended.join(given.select(*keys, _AT), [*keys, _AT], "left_anti").select(*attributes, _GONE, _AT)
        parts += [events(touched, start), ended]
        if repeats is not None:
            again, untouched_repeats = _apart(repeats, since, keys, F.col(f"d.`{start}`") >= F.col(f"s.{_FIRST}"))
            # Repeats before the first new row keep what the version in force was confirmed by; they need no replay.
            parts.append(events(again, start))
    everything = stored(union_all(*parts), "splice-events")
    line = scd2_history(
        everything, keys, [*tracking, _GONE], _AT, start=start, end=end, flag=flag, share=share, min_rows=min_rows
    )
    line = stored(line, "splice-line")
    versions = line.filter(F.col(_GONE).isNull()).select(version_key(keys, tracking, start).alias(surrogate_key), *attributes, start, end, flag)
    gone = line.filter(F.col(_GONE).isNotNull()).select(*keys, F.col(start).alias(end), _GONE)
    # What ends in a delete isn't current; only the version right before it knows why.
    versions = versions.join(gone, [*keys, end], "left")
    plain = [c for c in versions.columns if c != _GONE]
    if deletes:
        versions = versions.withColumns(
            {IS_DELETED: F.coalesce(f"{_GONE}.is_deleted", F.lit(False)), REASON: F.col(f"{_GONE}.delete_reason")}
        )
        plain += [IS_DELETED, REASON]
    order = dim.columns if dim is not None else [surrogate_key, *attributes, start, end, flag]
    versions = versions.select(*plain)
    if dim is not None:
        versions = versions.select(*[F.col(f"`{c}`").cast(dim.schema[c].dataType) for c in order if c in versions.columns])
    silent = everything.filter(F.col(_GONE).isNull()).select(*attributes, F.col(_AT).alias(start)).distinct()
    opened = line.select(*keys, start)
    silent = silent.join(opened, [*keys, start], "left_anti").select(*attributes, start)
    result = union_all(versions, untouched_dim)
    return Spliced(result.select(*order), union_all(silent, untouched_repeats))

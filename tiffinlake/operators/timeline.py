"""Ordered-per-key operators that stay parallel when one key owns a large part of the rows.

A window over a key runs in one task, however large the key. Keys with more than their share of the
rows are therefore cut along time into chunks, each an own window partition; a chunk that a burst
leaves above the share is cut once more within its own time range. What has to cross a chunk border
is one small row per chunk; these are combined separately and sent back.

The bound that makes this safe: at most ``1 / share`` keys, or chunks, can each hold more than
``share`` of the rows, and one is cut into about (its rows) / (share of all rows) pieces. So there are
never more than ``4 / share`` border rows, whatever the data, and broadcasting them is safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import as_list, row_struct
from ..sources.files import shared_folder
from .dedup import latest_per_key
from .planning import is_light, is_small, is_worth_broadcasting
from .scd2 import CURRENT, END, START, version_key

# A key is cut when it holds more than this share of all rows ...
HOT_SHARE = 1.0 / 5_000
# ... and more rows than one task sorts comfortably anyway.
HOT_ROWS = 1_000_000
# Up to so many versions a key, comparing a fact with each of them costs less than a time line.
FEW_VERSIONS = 8

_CHUNK = "__chunk"
# Room for the pieces of one chunk when chunks are renumbered: more than any cut can make.
_FAN = 1_000_000_000
# The end of a version in force, in microseconds; and over how many groups unmatchable facts go.
_FOREVER = 253402300799999999
_SPREAD = 10_000


def _counts(df: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """Rows and time range per group. Reads the group and the time only and combines map-side."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(micros).alias("lo"), F.max(micros).alias("hi")
    )


def _too_large(counts: DataFrame, by: Sequence[str], limit: Column) -> DataFrame:
    """Groups above the limit, with the start of their time range and the length of one piece."""
    pieces = F.ceil(F.col("n") / limit)
    width = ((F.col("hi") - F.col("lo")) / pieces + 1).cast("bigint")
    return counts.filter(F.col("n") > limit).select(*by, "lo", width.alias("width"))


def hot_cells(
    df: DataFrame, keys: Sequence[str], ts: str, share: float = HOT_SHARE, min_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(keys above the share, their chunks still above it). Each at most ``1 / share`` rows."""
    counts = _counts(df, keys, ts)
    # The total is taken over the same columns, so that Spark reuses the shuffle of the counts.
    overall = counts.agg(F.struct(F.sum("n").alias("n"), F.min("lo"), F.max("hi")).alias("all"))
    limit = F.greatest(F.lit(float(min_rows)), overall.scalar().getField("n") * F.lit(share))
    hot = _too_large(counts, keys, limit)
    first_cut = _cut(df.withColumn(_CHUNK, F.lit(0).cast("bigint")), hot, keys, ts, "inner")
    cell = [*keys, _CHUNK]
    return hot, _too_large(_counts(first_cut, cell, ts), cell, limit)


def _same_keys(keys: Sequence[str], left: str, right: str) -> Column:
    """NULL-safe: rows without a key are a group too, and may be the largest one."""
    condition = None
    for k in keys:
        one = F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
        condition = one if condition is None else condition & one
    return condition


def _cut(df: DataFrame, cells: DataFrame, on: Sequence[str], ts: str, how: str) -> DataFrame:
    """Renumbers chunks so that those inside a cell become several, in time order."""
    micros = F.unix_micros(F.col(f"d.`{ts}`").cast("timestamp"))
    piece = F.coalesce(F.floor((micros - F.col("c.lo")) / F.col("c.width")), F.lit(0))
    columns = [F.col(f"d.`{c}`") for c in df.columns if c != _CHUNK]
    return (
        df.alias("d")
        .join(F.broadcast(cells).alias("c"), _same_keys(on, "d", "c"), how)
        .select(*columns, (F.col(f"d.{_CHUNK}") * _FAN + piece).cast("bigint").alias(_CHUNK))
    )


def _with_chunks(
    df: DataFrame, hot: tuple[DataFrame, DataFrame], keys: list[str], ts: str, how: str
) -> DataFrame:
    """Numbers the chunks of hot keys; an ordinary key has chunk 0 only.

    "left" keeps all rows, "inner" those of hot keys. When there are no hot keys, adaptive execution
    finds the broadcast side empty and drops an inner branch without reading its input.
    """
    by_key, by_chunk = hot
    once = _cut(df.withColumn(_CHUNK, F.lit(0).cast("bigint")), by_key, keys, ts, how)
    return _cut(once, by_chunk, [*keys, _CHUNK], ts, "left")


def _with_borders(df: DataFrame, borders: DataFrame, keys: list[str]) -> DataFrame:
    """Each row next to the border row of its chunk; rows of ordinary keys have none."""
    on = _same_keys([*keys, _CHUNK], "d", "b")
    return df.alias("d").join(F.broadcast(borders).alias("b"), on, "left")


def scd2_history(
    events: DataFrame,
    natural_key: str | Sequence[str],
    tracking_columns: Sequence[str],
    ts: str,
    surrogate_key: str | None = None,
    tiebreak: str | Sequence[str] = (),
    distinct_times: bool = False,
    start: str = START,
    end: str = END,
    flag: str = CURRENT,
    share: float = HOT_SHARE,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """The dimension that results from replaying all batches in time order, in one pass.

    An event equal to the one before it changes nothing. Each remaining event is a version that
    ends where the next begins. Of several events of a key at the same instant only the last by
    ``tiebreak`` is ever in force; pass ``distinct_times`` when there are none, to save a shuffle.
    """
    keys, tracking = as_list(natural_key), list(tracking_columns)
    rows = events.select(*dict.fromkeys([*keys, *tracking, ts, *as_list(tiebreak)]))
    hot = hot_cells(rows, keys, ts, share, min_rows)
    if not distinct_times:
        rows = latest_per_key(rows, [*keys, ts], as_list(tiebreak))

    # Within a chunk: drop events that repeat the one before, then look ahead to the next start.
    in_chunk = Window.partitionBy(*keys, _CHUNK).orderBy(ts)

    def changes(how: str) -> DataFrame:
        return (
            _with_chunks(rows, hot, keys, ts, how)
            .select(*keys, *tracking, ts, _CHUNK, row_struct(tracking).alias("__row"))
            .withColumn("__prev", F.lag("__row").over(in_chunk))
            .filter(F.col("__prev").isNull() | ~F.col("__row").eqNullSafe(F.col("__prev")))
            .withColumn("__next", F.lead(ts).over(in_chunk))
        )

    # Between chunks of a hot key: does the first row repeat the last one of the chunk before, and
    # when does a later chunk first start a version?
    edge = F.struct(F.col(ts).alias("ts"), F.col("__row").alias("row"), F.col("__next").alias("next"))
    ends = changes("inner").groupBy(*keys, _CHUNK).agg(
        F.min(edge).alias("first"), F.max(edge).alias("last")
    )
    along = Window.partitionBy(*keys).orderBy(_CHUNK)
    repeats = F.coalesce(F.col("first.row").eqNullSafe(F.lag("last.row").over(along)), F.lit(False))
    borders = (
        ends.withColumn("repeats", repeats)
        .withColumn("opens", F.when(F.col("repeats"), F.col("first.next")).otherwise(F.col("first.ts")))
        .withColumn("then", F.min("opens").over(along.rowsBetween(1, Window.unboundedFollowing)))
        .select(*keys, _CHUNK, F.col("first.ts").alias("first_ts"), "repeats", "then")
    )
    joined = _with_borders(changes("left"), borders, keys).filter(
        ~F.coalesce(F.col("b.repeats") & (F.col(f"d.`{ts}`") == F.col("b.first_ts")), F.lit(False))
    )
    versions = joined.select(
        *[F.col(f"d.`{c}`") for c in [*keys, *tracking]],
        F.col(f"d.`{ts}`").cast("timestamp").alias(start),
        F.coalesce(F.col("d.__next"), F.col("b.then")).cast("timestamp").alias(end),
    ).withColumn(flag, F.col(end).isNull())
    if surrogate_key:
        versions = versions.select(version_key(keys, tracking, start).alias(surrogate_key), "*")
    return versions


def as_of_join(
    fact: DataFrame,
    dim: DataFrame,
    key: str | Sequence[str] | dict[str, str],
    ts: str,
    columns: Sequence[str] | None = None,
    start: str = START,
    end: str = END,
    how: str = "left",
    small_dim: bool | None = None,
    share: float = HOT_SHARE,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Each fact row with the dimension version valid at its time: ``start <= ts < end``.

    ``key`` maps fact columns to dimension columns where the names differ; ``columns`` are the
    dimension columns to attach. If versions of a key overlap, the one started last counts; of
    those started together the one that ends last, then the one with the largest columns; once that
    one has ended, none is in force. A fact without key or time has no version.

    A dimension that Spark would broadcast anyway is joined map-side, on the key with the time range
    as residual: the facts do not move. One without a key of more than ``FEW_VERSIONS`` versions is joined
    so too, by a shuffle. For others each distinct key and time of the facts is
    laid out with the versions on one time line per key and takes the last version started before
    it. That is a sort, so it never compares all times of a key with all its versions, and hot keys
    are cut as described above; many facts of one key at one instant are one point of the line. The
    line is kept in the shared folder, so lookups can follow each other: each one reads its facts
    once more and no plan contains another's. Both ways give the same rows.
    """
    pairs = key if isinstance(key, dict) else {k: k for k in as_list(key)}
    fact_keys, dim_keys = list(pairs), list(pairs.values())
    if columns is None:
        columns = [c for c in dim.columns if c not in dim_keys]
    columns = [c for c in columns if c not in fact.columns]
    needed = in_force(dim.select(*dict.fromkeys([*dim_keys, *columns, start, end])), dim_keys, start, end)
    most = None
    if small_dim is None:
        small_dim = is_small(needed) and is_light(needed)
        most = None if small_dim else most_versions(needed, dim_keys, start, end)
    if small_dim or (most is not None and most <= FEW_VERSIONS):
        return _as_of_lookup(fact, needed, pairs, ts, columns, start, end, how, most)

    starts = needed.select(
        *[F.col(f"`{d}`").alias(f) for f, d in pairs.items()],
        F.col(start).cast("timestamp").alias("__at"),
        F.lit(0).alias("__is_fact"),
        _version(columns, start, end).alias("__version"),
    )
    at = F.col(f"`{ts}`").cast("timestamp")
    asked = fact.select(*fact_keys, at.alias("__at")).dropna().distinct().withColumn("__is_fact", F.lit(1))
    line = starts.unionByName(asked, allowMissingColumns=True)
    path = shared_folder(line.sparkSession, "time-line")
    line.write.parquet(path)
    line = line.sparkSession.read.schema(line.schema).parquet(path)
    hot = hot_cells(line, fact_keys, "__at", share, min_rows)
    so_far = (
        Window.partitionBy(*fact_keys, _CHUNK)
        .orderBy("__at", "__is_fact", "__version")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = _with_chunks(line, hot, fact_keys, "__at", "left").withColumn(
        "__version", F.last("__version", ignorenulls=True).over(so_far)
    )

    # The version a chunk of a hot key inherits from the chunks before it.
    before = (
        Window.partitionBy(*fact_keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    borders = (
        _with_chunks(line, hot, fact_keys, "__at", "inner")
        .groupBy(*fact_keys, _CHUNK)
        .agg(F.max(F.when(F.col("__is_fact") == 0, F.col("__version"))).alias("newest"))
        .withColumn("inherited", F.last("newest", ignorenulls=True).over(before))
        .select(*fact_keys, _CHUNK, "inherited")
    )
    joined = _with_borders(filled.filter(F.col("__is_fact") == 1), borders, fact_keys)
    found = joined.select(
        *[F.col(f"d.`{k}`") for k in fact_keys],
        F.col("d.__at").alias("__at"),
        F.coalesce(F.col("d.__version"), F.col("b.inherited")).alias("__v"),
    ).filter(F.col("__v").isNotNull() & (F.col("__at") < F.col("__v.__end")))

    # Facts that can match nothing get a number each that no version has, so they are spread out.
    known = at.isNotNull()
    for k in fact_keys:
        known = known & F.col(f"`{k}`").isNotNull()
    spread = F.when(known, F.lit(0)).otherwise(F.pmod(F.xxhash64(*fact.columns), F.lit(_SPREAD)).cast("int") + 1)
    condition = (F.col("f.__at") == F.col("v.__at")) & (F.col("f.__spread") == F.col("v.__spread"))
    for k in fact_keys:
        condition = condition & (F.col(f"f.`{k}`") == F.col(f"v.`{k}`"))
    return (
        fact.withColumn("__at", at).withColumn("__spread", spread).alias("f")
        .join(found.withColumn("__spread", F.lit(0)).alias("v"), condition, how)
        .select(*[F.col(f"f.`{c}`") for c in fact.columns], *[F.col(f"v.__v.`{c}`").alias(c) for c in columns])
    )


def in_force(versions: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Versions without those that never are: of zero length, or without key or start."""
    return versions.filter(F.col(end).isNull() | (F.col(end) > F.col(start))).dropna(subset=[*keys, start])


def most_versions(versions: DataFrame, keys: Sequence[str], start: str, end: str) -> int:
    """The most versions that any key has."""
    counts = in_force(versions, keys, start, end).groupBy(*keys).count()
    return counts.agg(F.max("count")).first()[0] or 0


def _version(columns: Sequence[str], start: str, end: str) -> Column:
    """A version as a struct whose order decides between versions started together."""
    return F.struct(
        F.col(start).cast("timestamp").alias("__start"),
        F.coalesce(F.col(end).cast("timestamp"), F.timestamp_micros(F.lit(_FOREVER))).alias("__end"),
        *[F.col(f"`{c}`").alias(c) for c in columns],
    )


def _as_of_lookup(
    fact: DataFrame,
    dim: DataFrame,
    pairs: dict[str, str],
    ts: str,
    columns: Sequence[str],
    start: str,
    end: str,
    how: str,
    most: int | None = None,
) -> DataFrame:
    """The versions are first made to end where the next one starts.

    ``most`` is how many a key has at most, where the table isn't left to Spark to broadcast.
    """
    keys = list(pairs.values())
    if most is not None and most <= 1:
        version = _version(columns, start, end)
        versions = dim.select(*keys, version.alias("__v"), version.getField("__end").alias("__until"))
    else:
        once = dim.groupBy(*keys, start).agg(F.max(_version(columns, start, end)).alias("__v"))
        next_start = F.lead("__v.__start").over(Window.partitionBy(*keys).orderBy("__v.__start"))
        versions = once.select(*keys, "__v", F.least(F.col("__v.__end"), next_start).alias("__until"))
    if most is not None:
        versions = F.broadcast(versions) if is_worth_broadcasting(dim, fact) else versions.hint("merge")
    at = F.col(f"f.`{ts}`").cast("timestamp")
    condition = (at >= F.col("v.__v.__start")) & (at < F.col("v.__until"))
    for f, d in pairs.items():
        condition = (F.col(f"f.`{f}`") == F.col(f"v.`{d}`")) & condition
    return (
        fact.alias("f")
        .join(versions.alias("v"), condition, how)
        .select(*[F.col(f"f.`{c}`") for c in fact.columns], *[F.col(f"v.__v.`{c}`").alias(c) for c in columns])
    )

"""Change feeds of a table, each change consumed once.

A snapshot table publishes versions. Every published version is announced by a small file beside the
versions, in their order, and a file stream over these is what tells a consumer that there is something
new. What it consumes is the net change between the source version it stands at and the newest one: a row
changed twice in between is reported once, and one that came and went not at all.

Where a consumer stands is written in its own sink, whose version n is what follows from source version n.
A batch repeated after a failure therefore starts from the same version and replaces what the broken one
left; one whose version is already there does nothing. That holds even if the checkpoint is lost: it
saves work, it isn't what makes the effect happen once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.keys import as_list
from ..operators.change_feed import ACTION, IS_UPDATE, change_feed
from ..operators.upsert import upsert
from ..sources import files, tables

ANNOUNCED = "announced"
FROM_VERSION, TO_VERSION = "from_version", "to_version"

#: (sink's rows so far or None, changes, source version before or None, source version after) -> sink's rows.
Apply = Callable[[DataFrame | None, DataFrame, int | None, int], DataFrame]


class StaleFeed(ValueError):
    """The version a consumer stands at has expired: its changes can't be told any more."""


def announce(spark: SparkSession, source: str) -> list[int]:
    """Announces the published versions that aren't yet, oldest first; returns them.

    A job that dies between publishing and announcing leaves that to the next call.
    """
    folder = f"{source}/{ANNOUNCED}"
    known = set(files.child_names(spark, folder))
    fresh = [v for v in tables.snapshot_versions(spark, source) if f"{v:020d}.json" not in known]
    for v in fresh:
        files.put_text(spark, f"{folder}/{v:020d}.json", f'{{"version":{v}}}\n')
    return fresh


def publish(df: DataFrame, source: str, version: int | None = None) -> int:
    """Writes the next version of a table and announces it."""
    version = tables.write_snapshot(df, source, version)
    announce(df.sparkSession, source)
    return version


def changes_between(
    spark: SparkSession, source: str, before: int | None, after: int, keys: str | Sequence[str]
) -> DataFrame:
    """The change feed from one version to another; without a version before, every row is an insert."""
    now = tables.read_snapshot(spark, source, after)
    if before is None:
        return now.withColumns({ACTION: F.lit("INSERT"), IS_UPDATE: F.lit(False)})
    if before not in tables.snapshot_versions(spark, source):
        raise StaleFeed(f"version {before} of {source} has expired; load the consumer anew")
    return change_feed(tables.read_snapshot(spark, source, before), now, keys)


def replicate(keys: str | Sequence[str]) -> Apply:
    """Keeps the sink equal to the source: inserts, updates and deletes as the feed reports them."""
    names = as_list(keys)

    def apply(current: DataFrame | None, changes: DataFrame, before: int | None, after: int) -> DataFrame:
        gone = (F.col(ACTION) == "DELETE") & ~F.col(IS_UPDATE)
        rows = changes.filter(gone | (F.col(ACTION) == "INSERT")).withColumn("__gone", gone).drop(ACTION, IS_UPDATE)
        merged = upsert(current, rows, names)
        return merged.filter(~F.coalesce(F.col("__gone"), F.lit(False))).drop("__gone")

    return apply


def log_changes(current: DataFrame | None, changes: DataFrame, before: int | None, after: int) -> DataFrame:
    """The changes themselves, with the versions they lie between: a sink version is one entry of a log."""
    return changes.withColumns({FROM_VERSION: F.lit(before).cast("long"), TO_VERSION: F.lit(after).cast("long")})


def read_log(spark: SparkSession, sink: str) -> DataFrame:
    """All entries of a log of changes."""
    return spark.read.parquet(*[f"{sink}/v={v}" for v in tables.snapshot_versions(spark, sink)])


def consume_changes(
    spark: SparkSession,
    source: str,
    sink: str,
    keys: str | Sequence[str],
    checkpoint: str,
    apply: Apply,
    **trigger,
) -> StreamingQuery:
    """Applies what changed in the table at ``source`` to the snapshot table at ``sink``.

    ``trigger`` is a trigger of Structured Streaming; by default all that is new is taken and the query
    stops. Versions must not expire before every consumer has passed them (``StaleFeed``).
    """

    def step(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        after = batch.agg(F.max("version")).first()[0]
        done = tables.snapshot_versions(session, sink)
        if after is None or (done and done[-1] >= after):
            return
        before = done[-1] if done else None
        changes = changes_between(session, source, before, after, keys)
        current = tables.read_snapshot(session, sink, before) if done else None
        tables.write_snapshot(apply(current, changes, before, after), sink, after)

    announce(spark, source)
    # One micro-batch takes all versions that are announced, as their changes are netted anyway.
    news = spark.readStream.schema("version long").json(f"{source}/{ANNOUNCED}")
    return (
        news.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

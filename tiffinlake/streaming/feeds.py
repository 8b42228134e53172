"""Append-only feeds over landing folders and upserts driven by them.

The checkpoint records which files were consumed, so each is read once. ``availableNow`` takes all
that is new, in bounded micro-batches, and stops: a stream for the tracking, a batch job to run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.keys import as_list
from ..operators.dedup import latest_per_key
from ..operators.upsert import upsert
from ..sources import tables
from ..sources.raw import CSV_DIALECT

# Files per micro-batch: bounds what one micro-batch and its retry have to process.
MAX_FILES = 10_000


def append_feed(spark: SparkSession, src_dir: str, schema: StructType, max_files: int = MAX_FILES) -> DataFrame:
    """New files of a folder as a stream of text rows."""
    return (
        spark.readStream.schema(schema)
        .options(**CSV_DIALECT)
        .option("maxFilesPerTrigger", max_files)
        .csv(src_dir)
    )


def stream_append(feed: DataFrame, sink_dir: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new to a Parquet table, exactly once."""
    return (
        feed.writeStream.format("parquet")
        .option("path", sink_dir)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_upsert(
    spark: SparkSession,
    src_dir: str,
    schema: StructType,
    target: str,
    keys: str | Sequence[str],
    checkpoint: str,
    order_by: str | Sequence[str],
    transform: Callable[[DataFrame], DataFrame] | None = None,
    only_if_changed: bool = False,
    max_files: int = MAX_FILES,
    partition_by: str | None = None,
) -> StreamingQuery:
    """Upserts what is new into the table at ``target``.

    By default that is a snapshot table: micro-batch n reads version n and writes version n + 1, so
    a batch repeated after a failure rewrites the same version from the same input. For large
    targets name a ``partition_by`` column: a micro-batch then rewrites only the partitions it
    affects, and repeating it upserts the same rows again. Either way the effect happens once.
    """
    keys = as_list(keys)

    def merge_affected(batch: DataFrame, _: int) -> None:
        rows = latest_per_key(transform(batch) if transform else batch, keys, order_by)
        updated = [c for c in rows.columns if c not in keys and c != partition_by]
        tables.merge_partitions(
            batch.sparkSession, target, rows, keys, partition_by,
            lambda current, new: upsert(current, new, keys, updated, only_if_changed=only_if_changed),
        )

    def merge_snapshot(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        published = [v for v in tables.snapshot_versions(session, target) if v <= batch_id]
        current = tables.read_snapshot(session, target, published[-1]) if published else None
        rows = transform(batch) if transform else batch
        merged = upsert(current, rows, keys, only_if_changed=only_if_changed, order_by=order_by)
        tables.write_snapshot(merged, target, batch_id + 1)

    return (
        append_feed(spark, src_dir, schema, max_files)
        .writeStream.foreachBatch(merge_affected if partition_by else merge_snapshot)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

"""Parquet tables: appends partitioned by batch date, clustered layouts, versioned snapshots."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.keys import packed_key, unpacked_key
from . import files
from .curve import along_curve

BATCH_COLUMN = "_execution_date"
#: Where a table keeps its schema: a folder that Spark's readers pass over, with a file per change.
SCHEMA = "_schema"
#: Digests in hexadecimal, which fill the warehouse's tables, take half as much with it as with the default.
CODEC = "zstd"
_VERSION = re.compile(r"^v=(\d+)$")


#: The tables that each open ``scratch`` deletes at its end, innermost last.
_scopes: list[list[str]] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, keep: int = 0, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again.

    This computes it once for several readers and cuts its lineage, and it outlives executors. Inside
    ``scratch`` the table lives as long as that; it outlives the ``keep`` innermost ones.
    """
    spark = df.sparkSession
    path = files.shared_folder(spark, name)
    for scope in _scopes[: max(0, len(_scopes) - keep)][-1:]:
        scope.append(path)
    writer = df.write if codec is None else df.write.option("compression", codec)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Frees what steps inside leave on disk: stored tables at the end, shuffle files with the job they served.

    Nothing computed inside may be read after it, but for tables stored with ``keep``.
    """
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            files.delete(spark, path)
        spark.conf.set(CLEANUP, before)


def stored_schema(spark: SparkSession, path: str) -> StructType | None:
    """The schema a table keeps, None if it keeps none."""
    names = sorted(n for n in files.child_names(spark, f"{path}/{SCHEMA}") if n.endswith(".json") and n[0] != ".")
    return StructType.fromJson(json.loads(files.get_text(spark, f"{path}/{SCHEMA}/{names[-1]}"))) if names else None


def keep_schema(spark: SparkSession, path: str, schema: StructType) -> None:
    """Adds the columns of what is about to be written to the schema that a table keeps.

    A table that keeps none yet is asked for it once, by merging the schemas of its files.
    """
    known = stored_schema(spark, path)
    fields = list(known or (spark.read.option("mergeSchema", "true").parquet(path).schema if _has_files(spark, path) else []))
    names = {f.name for f in fields}
    fields += [StructField(f.name, f.dataType) for f in schema if f.name not in names]
    if known is None or len(fields) > len(known):
        n = len(files.child_names(spark, f"{path}/{SCHEMA}"))
        files.put_text(spark, f"{path}/{SCHEMA}/{n:06d}.json", StructType(fields).json())


def _has_files(spark: SparkSession, path: str) -> bool:
    """Whether a table has files or partitions, whose folders may begin with an underscore."""
    return any("=" in n or n[0] not in "._" for n in files.child_names(spark, path))


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "append",
    partition_by: Sequence[str] | None = None,
    cluster_by: Sequence[str] | None = None,
    clusters: int | None = None,
    keep: bool = True,
    curve_by: Sequence[str] | None = None,
    digests: Sequence[str] = (),
) -> None:
    """Writes Parquet. Columns new to the table are fine: it keeps its schema (``keep``), which grows with them.

    ``cluster_by`` range-partitions and sorts, so files cover narrow value ranges and their
    min/max statistics skip most of them; it also compacts many small files into few.

    ``curve_by`` orders rows along a curve through several columns instead, so that files are narrow in each
    of them; ``df`` is read twice then, once for quantiles.

    A partitioned write is rebalanced first: rows of a partition come together, so not every task
    writes a file into every partition, and adaptive execution splits the large partitions again,
    so none is written by a single task. Columns named in ``digests`` are packed on the way.
    """
    columns = df.columns
    if curve_by:
        df = along_curve(df, curve_by, clusters)
    elif cluster_by:
        n = (clusters,) if clusters else ()
        df = df.repartitionByRange(*n, *cluster_by).sortWithinPartitions(*cluster_by)
    elif partition_by:
        moved = df.withColumns({c: packed_key(c) for c in digests}).hint("rebalance", *[F.col(c) for c in partition_by])
        df = moved.withColumns({c: unpacked_key(c) for c in digests}).select(*columns)
    schema = df.schema
    if keep and mode != "overwrite":
        keep_schema(df.sparkSession, path, schema)
    writer = df.write.mode(mode).option("compression", CODEC)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if keep and mode == "overwrite":
        keep_schema(df.sparkSession, path, schema)


def write_batch(df: DataFrame, path: str, execution_date: str, then_by: Sequence[str] = ()) -> None:
    """Writes one batch date and replaces only that date, so a rerun leaves no duplicates.

    Within the date rows are partitioned by ``then_by``; a rerun replaces the partitions it has rows for.
    """
    stamped = df.withColumn(BATCH_COLUMN, F.lit(execution_date).cast("date"))
    keep_schema(df.sparkSession, path, stamped.schema)
    (
        stamped.write.mode("overwrite")
        .option("compression", CODEC)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(BATCH_COLUMN, *then_by)
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str, merge_schema: bool = True) -> DataFrame:
    """A table with the schema it keeps, so that no file is opened to learn it.

    Of one that keeps none ``merge_schema`` shows the columns that only later files have; that opens every
    file's footer.
    """
    schema = stored_schema(spark, path)
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    return spark.read.option("mergeSchema", merge_schema).parquet(path)


def read_batch(spark: SparkSession, path: str, execution_date: str) -> DataFrame:
    """The rows of one batch date, without listing or opening the files of any other."""
    day = F.lit(execution_date).cast("date")
    folder = f"{path}/{BATCH_COLUMN}={execution_date}"
    if not files.exists(spark, folder):
        return read_table(spark, path, merge_schema=False).filter(F.lit(False))
    schema = stored_schema(spark, path)
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", "true")
    reader = reader.option("basePath", path)
    return reader.parquet(folder).filter(F.col(BATCH_COLUMN) == day)


def snapshot_versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, oldest first: a version exists once its job has committed."""
    found = [int(m.group(1)) for m in map(_VERSION.match, files.child_names(spark, path)) if m]
    return sorted(v for v in found if files.exists(spark, f"{path}/v={v}/_SUCCESS"))


def write_snapshot(
    df: DataFrame,
    path: str,
    version: int | None = None,
    partition_by: Sequence[str] | None = None,
) -> int:
    """Writes a whole table as a new version and returns its number.

    Spark will not overwrite files it is reading, and a reader should never see half a table:
    each version has a directory of its own that counts only once committed. Writing the same
    version again replaces it, which makes retries harmless.
    """
    if version is None:
        published = snapshot_versions(df.sparkSession, path)
        version = published[-1] + 1 if published else 0
    write_table(df, f"{path}/v={version}", "overwrite", partition_by, keep=False)
    return version


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A version of the table, the latest by default; None when nothing is published yet."""
    published = snapshot_versions(spark, path)
    if version is None:
        if not published:
            return None
        version = published[-1]
    elif version not in published:
        raise ValueError(f"no version {version} under {path}")
    return spark.read.parquet(f"{path}/v={version}")


def merge_partitions(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    keys: Sequence[str],
    partition_by: str,
    merge: Callable[[DataFrame | None, DataFrame], DataFrame],
    holding: Sequence | None = None,
    digests: Sequence[str] = (),
) -> None:
    """Applies ``merge(current rows, source)`` to the partitions that ``source`` affects, only.

    A daily batch touches a few partitions of a table that may hold years. Affected are those where
    one of its keys is already stored, found by reading keys and nothing else, and those its own
    rows belong to. A caller that knows which partitions may hold its keys names them in ``holding``,
    and no key is read. ``merge`` must leave the partition column of stored rows alone and must not
    empty a partition.

    The result is staged inside the table's folder, where readers don't see it, before it replaces
    anything. A complete staging found at the start is what an earlier job did not finish: it is put
    in place first, so a job that died half-way through the replacement has lost nothing, and running
    its batch again finds all rows. An incomplete one is dropped.

    Partition values have the type they have in ``source``; NULL is a partition like any other.
    Columns named in ``digests`` are surrogate keys, which are moved packed.
    """
    if not files.exists(spark, path):
        write_table(merge(None, source), path, "overwrite", [partition_by], digests=digests)
        return
    partition = source.schema[partition_by]
    _finish_replacement(spark, path, partition)
    table = _read_partitioned(spark, path, partition)
    found = source.select(partition_by)
    if holding is None:
        hit = table.select(*keys, partition_by).join(source.select(*keys), list(keys), "left_semi")
        found = hit.select(partition_by).unionByName(found)
    # At most one row per partition of the table reaches the driver.
    affected = [r[0] for r in found.distinct().collect()]
    affected += [v for v in holding or () if v not in affected]
    if not affected:
        return
    current = table.filter(one_of(partition_by, affected))
    replace_partitions(spark, path, merge(current, source), partition, digests)


STAGING = "_replacement"


def one_of(name: str, values: Sequence) -> Column:
    """Whether a column has one of the values, which may include NULL."""
    found = F.col(name).isin([v for v in values if v is not None])
    return found | F.col(name).isNull() if None in values else found


def _read_partitioned(spark: SparkSession, path: str, partition: StructField) -> DataFrame:
    """The table with its partition column as declared, not as its values look."""
    found = read_table(spark, path).schema
    fields = [partition if f.name == partition.name else f for f in found]
    return spark.read.schema(StructType(fields)).parquet(path)


def replace_partitions(
    spark: SparkSession, path: str, df: DataFrame, partition: StructField, digests: Sequence[str] = ()
) -> None:
    """Replaces the partitions that ``df`` has rows for, so that a broken replacement can be finished."""
    write_table(df, f"{path}/{STAGING}", "overwrite", [partition.name], keep=False, digests=digests)
    _finish_replacement(spark, path, partition)


def _finish_replacement(spark: SparkSession, path: str, partition: StructField) -> None:
    staging = f"{path}/{STAGING}"
    if not files.exists(spark, staging):
        return
    if files.exists(spark, f"{staging}/_SUCCESS") and _has_files(spark, staging):
        rows = _read_partitioned(spark, staging, partition)
        keep_schema(spark, path, rows.schema)
        (
            rows.write.mode("overwrite")  # staged files hold a partition each, so nothing is shuffled again
            .option("compression", CODEC)
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(partition.name)
            .parquet(path)
        )
    files.delete(spark, staging)


def compact_partitions(spark: SparkSession, path: str, partition: StructField, more_than: int = 8) -> list:
    """Rewrites the partitions that have more than so many files into few; returns their values."""
    table = _read_partitioned(spark, path, partition)
    names = table.select(partition.name, F.col("_metadata.file_path").alias("file")).distinct()
    many = names.groupBy(partition.name).count().filter(F.col("count") > more_than)
    values = [r[0] for r in many.select(partition.name).collect()]
    if values:
        replace_partitions(spark, path, table.filter(one_of(partition.name, values)), partition)
    return values


def expire_snapshots(
    spark: SparkSession, path: str, older_than_hours: float = 168, keep: int = 1, now_millis: int | None = None
) -> list[int]:
    """Deletes versions committed so long ago, but never the last ``keep`` (at least the latest)."""
    limit = (int(time.time() * 1000) if now_millis is None else now_millis) - older_than_hours * 3_600_000
    candidates = snapshot_versions(spark, path)[: -max(keep, 1)]
    gone = [v for v in candidates if files.modified_millis(spark, f"{path}/v={v}/_SUCCESS") < limit]
    for v in gone:
        files.delete(spark, f"{path}/v={v}")
    return gone

"""Bronze: all-text CSV with file lineage."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.keys import as_timestamp
from . import quoted

# Comma separated, one header line, optional double quotes, \N for NULL.
CSV_DIALECT = {
    "header": "true",
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "nullValue": "\\N",
    "enforceSchema": "true",
}

# Text of a line that does not have the expected number of fields, else NULL.
MALFORMED = "_malformed"


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def scan_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str],
    mode: str = "PERMISSIVE",
    multi_line: bool = False,
    malformed: str | None = None,
) -> DataFrame:
    """Files in place, n-th field bound to the n-th name whatever the header says.

    ``mode``: PERMISSIVE keeps bad lines, DROPMALFORMED skips them, FAILFAST aborts the load.
    ``malformed`` names a column for the text of lines with missing or surplus fields. With
    ``multi_line`` quoted fields may hold line breaks, but a file is then one task's work; without it
    such a field ends with its line, so leave it out only for files known to have none.
    """
    names = [*columns, malformed] if malformed else columns
    reader = spark.read.schema(text_schema(names)).options(**CSV_DIALECT)
    if malformed:
        reader = reader.option("columnNameOfCorruptRecord", malformed)
    return reader.option("mode", mode).option("multiLine", multi_line).csv(path)


def scan_records(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str],
    mode: str = "PERMISSIVE",
    malformed: str | None = None,
) -> DataFrame:
    """As ``scan_csv`` with ``multi_line``, but a file is the work of many tasks; adds file and modified."""
    if mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
        raise ValueError(f"unknown mode {mode}")
    bad = malformed or MALFORMED
    parser = "FAILFAST" if mode == "FAILFAST" else "PERMISSIVE"
    options = {k: v for k, v in CSV_DIALECT.items() if k not in ("header", "enforceSchema")}
    options |= {"mode": parser, "columnNameOfCorruptRecord": bad, "maxCharsPerColumn": "-1"}
    schema = ", ".join(f"`{f.name}` string" for f in text_schema([*columns, bad]))
    found = quoted.records(spark, path).filter(~F.col("first"))
    found = found.withColumn("row", F.from_csv("record", schema, options))
    if mode == "DROPMALFORMED":
        found = found.filter(F.col(f"row.`{bad}`").isNull())
    names = [*columns, malformed] if malformed else columns
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "file", "modified")


def read_raw(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str],
    execution_date: str,
    mode: str = "PERMISSIVE",
    batch_ts=None,
    with_md5: bool = False,
    malformed: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """CSV scan plus file name, file time, load time and batch date per row.

    With ``multi_line`` quoted fields may hold line breaks; large files are still read by many tasks.
    """
    if multi_line:
        lines, file, modified = scan_records(spark, path, columns, mode, malformed), "file", "modified"
    else:
        lines = scan_csv(spark, path, columns, mode, False, malformed)
        file, modified = "_metadata.file_path", "_metadata.file_modification_time"
    raw = lines.select(
        *[F.col(f"`{c}`") for c in columns],
        *([malformed] if malformed else []),
        F.col(file).alias("_stg_file_name"),
        F.col(modified).alias("_stg_file_load_ts"),
        as_timestamp(batch_ts).alias("_copy_data_ts"),
        F.lit(execution_date).cast("date").alias("_execution_date"),
    )
    if not with_md5:
        return raw
    return raw.join(file_digests(spark, path), "_stg_file_name", "left").select(*raw.columns, "_stg_file_md5")


def list_files(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Path, size and time of every file below ``path``; contents are pruned from the scan."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("_metadata.file_path").alias("path"), "length", "modificationTime")


#: Files up to this size are read whole, as one value; Spark's own limit is 2 GB.
WHOLE_FILE = 256 << 20
#: Bytes of a larger file that a task holds at once.
BLOCK = 8 << 20


def file_digests(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One content digest per file, its MD5, whatever its size: (_stg_file_name, _stg_file_md5).

    A file's bytes have to pass in order, so a file is one task's work. Files of up to ``WHOLE_FILE`` come
    through Spark's reader; larger ones are opened by the tasks, a task a file, with Arrow's file systems (local,
    HDFS, S3, GCS, Azure), and pass a block at a time.
    """
    name = F.col("_metadata.file_path").alias("_stg_file_name")
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = binary.filter(F.col("length") <= WHOLE_FILE).select(name, F.md5("content").alias("_stg_file_md5"))
    large = binary.filter(F.col("length") > WHOLE_FILE).select(name)
    block = BLOCK

    def digest(batches):
        for batch in batches:
            found = []
            for uri in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(uri)
                md5 = hashlib.md5(usedforsecurity=False)
                with store.open_input_stream(inner) as stream:
                    while data := stream.read(block):
                        md5.update(data)
                found.append(md5.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["_stg_file_name", "_stg_file_md5"])

    streamed = large.mapInArrow(digest, "_stg_file_name string, _stg_file_md5 string")
    return small.unionByName(streamed)

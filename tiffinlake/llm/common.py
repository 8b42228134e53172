"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.files import shared_folder
from ..sources.tables import CLEANUP, _scopes, scratch  # noqa: F401

#: White space that separates words, and its complement, a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table, so that extra columns never clash with an operator's own."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def text_of(column: str = "text") -> Column:
    """The text; a null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def stored(df: DataFrame, name: str, keep: int = 0) -> DataFrame:
    """``df`` written to the shared folder and read again.

    This computes it once for several readers and cuts its lineage, and it outlives executors. Inside
    ``scratch`` the table lives as long as that; it outlives the ``keep`` innermost ones.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    for scope in _scopes[: max(0, len(_scopes) - keep)][-1:]:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

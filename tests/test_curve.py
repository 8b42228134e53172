import random
from datetime import date, datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import rows
from tiffinlake.sources import curve, tables


def files_read(path, column, low, high):
    """The share of files whose statistics don't rule out values between the bounds."""
    hit = total = 0
    for file in sorted(path.glob("*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            stats = next(c.statistics for c in (meta.row_group(g).column(i) for i in range(meta.num_columns)) if c.path_in_schema == column)
            total += 1
            hit += stats.min <= high and stats.max >= low
    return hit / total


def test_a_filter_on_any_column_reads_few_files(spark, tmp_path):
    rng = random.Random(4)
    data = [(rng.randint(0, 10**6), rng.gauss(0, 1) ** 3, "".join(rng.choices("abcdef", k=5))) for _ in range(20_000)]
    df = spark.createDataFrame(data, "a long, b double, c string")
    tables.write_table(df, str(tmp_path / "curve"), "overwrite", curve_by=["a", "b", "c"], clusters=64)
    tables.write_table(df, str(tmp_path / "list"), "overwrite", cluster_by=["a", "b", "c"], clusters=64)
    filters = {"a": (600_000, 620_000), "b": (0.01, 0.02), "c": ("cc", "cd")}
    shares = {c: files_read(tmp_path / "curve", c, *f) for c, f in filters.items()}
    # 64 files are four bins a column; a file that crosses the end of a bin is read for both.
    assert all(share < 0.6 for share in shares.values()) and sum(shares.values()) < 1.35, shares
    assert files_read(tmp_path / "list", "b", *filters["b"]) > 0.9
    assert rows(tables.read_table(spark, str(tmp_path / "curve"))) == sorted(data, key=repr)


def test_bins_are_quantiles_and_places_interleave_them(spark):
    df = spark.range(4096).select(F.col("id").alias("a"), (F.lit(4095) - F.col("id")).alias("b"))
    placed = df.select("a", curve.curve_key(df, ["a"]).alias("p"), curve.curve_key(df, ["a", "b"]).alias("q")).orderBy("a").collect()
    bins = [r.p for r in placed]
    assert bins == sorted(bins) and bins[0] == 0 and bins[-1] == 255
    counts = [bins.count(i) for i in range(256)]
    assert max(counts) <= 20 and min(counts) >= 12

    def interleaved(x, y):
        return sum(((x >> i & 1) << (2 * i + 1)) | ((y >> i & 1) << (2 * i)) for i in range(8))

    other = {r.a: r.p for r in df.select("a", curve.curve_key(df, ["b"]).alias("p")).collect()}
    assert all(r.q == interleaved(r.p, other[r.a]) for r in placed)


def test_one_place_for_most_rows_is_dealt_out(spark):
    df = spark.range(9000).select(F.when(F.col("id") < 8000, 7).otherwise(F.col("id")).alias("a"), F.lit(None).cast("string").alias("b"))
    dealt = curve.along_curve(df, ["a", "b"], 8)
    sizes = [r[1] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 9000 and max(sizes) < 2500


def test_kinds_of_columns(spark):
    when = datetime(2024, 1, 2)
    df = spark.createDataFrame([(True, date(2024, 1, 1), when, when, "é", None)], "a boolean, b date, c timestamp, d timestamp_ntz, e string, f int")
    assert curve.along_curve(df, ["a", "b", "c", "d", "e", "f"]).count() == 1
    assert curve.along_curve(df.filter("false"), ["a", "f"]).count() == 0
    with pytest.raises(TypeError):
        curve.curve_key(df.select(F.array("a").alias("a")), ["a"])
    with pytest.raises(ValueError):
        curve.curve_key(df, [])

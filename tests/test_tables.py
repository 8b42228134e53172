import hashlib

import pytest
from pyspark.sql import functions as F

from helpers import CSV, drop_file, rows
from tiffinlake.plans import entities as en
from tiffinlake.operators.quarantine import bad_rows, flag_invalid, good_rows, load_rules
from tiffinlake.sources import files, raw, tables


def test_lineage_and_digest(spark, tmp_path):
    folder = drop_file(tmp_path / "in", en.CUSTOMER, CSV["customer"])
    df = raw.read_raw(spark, folder, en.CUSTOMER.raw_columns, "2023-01-15", batch_ts="2023-01-16 00:00:00", with_md5=True)
    row = df.collect()[0]
    path = tmp_path / "in" / "customer.csv"
    assert row._stg_file_name.endswith("/in/customer.csv")
    assert row._stg_file_md5 == hashlib.md5(path.read_bytes()).hexdigest()
    assert str(row._execution_date) == "2023-01-15" and str(row._copy_data_ts) == "2023-01-16 00:00:00"
    assert df.count() == 2 and row.customerid == "7"


def test_digest_is_the_md5_of_any_file_name(spark, tmp_path):
    for name in ("a b.csv", "ü%20.csv"):
        (tmp_path / name).write_text(f"h\n{name}\n")
    df = raw.read_raw(spark, str(tmp_path), ["v"], "2023-01-15", with_md5=True)
    assert {r.v: r._stg_file_md5 for r in df.collect()} == {
        n: hashlib.md5((tmp_path / n).read_bytes()).hexdigest() for n in ("a b.csv", "ü%20.csv")
    }
    listed = {r.path for r in raw.list_files(spark, str(tmp_path)).collect()}
    assert listed == {r._stg_file_name for r in df.collect()}


def test_malformed_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,x\n4,5,6\n3\n7,"two\nlines"\nkey,y\n')
    df = raw.read_raw(spark, str(tmp_path), ["k", "v"], "2023-01-15", malformed=raw.MALFORMED, multi_line=True)
    flagged = flag_invalid(df, load_rules({"k": "bigint"}, raw.MALFORMED)).cache()
    assert flagged.count() == 5, "rows in are rows out"
    assert rows(good_rows(flagged), "k", "v") == [("1", "x"), ("7", "two\nlines")]
    bad = {r._malformed or r.k: r._failed_rules for r in bad_rows(flagged).collect()}
    assert bad["4,5,6"] == bad["3"] == "malformed" and bad["key"] == "no_k"


def test_dialect_null_quotes_and_modes(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,\\N\n2,"x,y"\n3\n')
    df = raw.scan_csv(spark, str(tmp_path), ["k", "v"])
    assert rows(df) == [("1", None), ("2", "x,y"), ("3", None)]
    with pytest.raises(Exception):
        raw.scan_csv(spark, str(tmp_path), ["k", "v"], mode="FAILFAST").collect()


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "delta").mkdir()
    (tmp_path / "delta" / "x.csv").write_text("a\n1\n")
    listed = raw.list_files(spark, str(tmp_path))
    assert [(r.path[-5:], r.length) for r in listed.collect()] == [("x.csv", 4)]
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_batches_replace_only_their_date(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_batch(spark.range(3), path, "2024-01-01")
    tables.write_batch(spark.range(5), path, "2024-01-02")
    tables.write_batch(spark.range(2).withColumn("extra", F.lit("x")), path, "2024-01-01")
    assert tables.read_batch(spark, path, "2024-01-01").count() == 2
    assert tables.read_batch(spark, path, "2024-01-02").count() == 5
    assert "extra" in tables.read_table(spark, path).columns
    assert tables.read_batch(spark, path, "2024-01-03").count() == 0
    assert all("_execution_date=2024-01-02" in f for f in tables.read_batch(spark, path, "2024-01-02").inputFiles())
    plan = tables.read_batch(spark, path, "2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_execution_date" in plan


def test_snapshots_publish_whole_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    assert tables.read_snapshot(spark, path) is None
    assert tables.write_snapshot(spark.range(3), path) == 0
    current = tables.read_snapshot(spark, path)
    # The new version is computed from the one being replaced.
    assert tables.write_snapshot(current.unionByName(spark.range(10, 12)), path) == 1
    assert tables.read_snapshot(spark, path).count() == 5
    assert tables.read_snapshot(spark, path, 0).count() == 3
    (tmp_path / "s" / "v=2").mkdir()  # a version whose job never committed
    assert tables.snapshot_versions(spark, path) == [0, 1]
    with pytest.raises(ValueError):
        tables.read_snapshot(spark, path, 2)


def test_clustered_files_have_disjoint_ranges(spark, tmp_path):
    path = str(tmp_path / "c")
    tables.write_table(spark.range(0, 10_000, 1, 8).select((F.col("id") * 7919 % 10_000).alias("id")), path,
                       "overwrite", cluster_by=["id"], clusters=4)
    per_file = (
        spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    )
    ranges = sorted((r.lo, r.hi) for r in per_file.collect())
    assert len(ranges) == 4 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_shared_folder_comes_from_the_session(spark):
    assert files.shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_merge_touches_only_affected_partitions(spark, tmp_path):
    from tiffinlake.operators.upsert import upsert

    path = str(tmp_path / "m")
    schema = "k bigint, v string, month int"
    merge = lambda current, batch: upsert(current, batch, "k", ["v"])

    def run(*values):
        tables.merge_partitions(spark, path, spark.createDataFrame(list(values), schema), ["k"], "month", merge)
        return rows(tables.read_table(spark, path), "k", "v", "month")

    run((1, "a", 202301), (2, "b", 202302), (3, "c", 202303))
    untouched = sorted(p.name for p in (tmp_path / "m" / "month=202303").iterdir())
    # Key 1 comes again under another month: it stays where it is stored.
    assert run((1, "A", 202302), (4, "d", 202304)) == [
        (1, "A", 202301), (2, "b", 202302), (3, "c", 202303), (4, "d", 202304),
    ]
    assert sorted(p.name for p in (tmp_path / "m" / "month=202303").iterdir()) == untouched
    assert run((1, "A", 202302), (4, "d", 202304))[0] == (1, "A", 202301), "again: no change"


def test_partitioned_writes_are_few_files(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(0, 8000, 1, 8).select("id", (F.col("id") % 10).cast("int").alias("part"))
    tables.write_table(df, path, "overwrite", ["part"])
    assert len(list((tmp_path / "p").glob("part=*/*.parquet"))) <= 20
    assert spark.read.parquet(path).count() == 8000


def _merger(spark, path, schema):
    from tiffinlake.operators.upsert import upsert

    def run(*values):
        source = spark.createDataFrame(list(values), schema)
        tables.merge_partitions(spark, path, source, ["k"], "p", lambda c, b: upsert(c, b, "k", ["v"]))
        return rows(tables._read_partitioned(spark, path, source.schema["p"]), "k", "v", "p")

    return run


def test_merge_keeps_the_null_partition_and_declared_types(spark, tmp_path):
    run = _merger(spark, str(tmp_path / "n"), "k bigint, v string, p string")
    run((1, "a", None), (2, "b", None), (3, "c", "01"), (4, "d", "02"))
    assert run((9, "n", None), (3, "C", "01")) == [(1, "a", None), (2, "b", None), (3, "C", "01"), (4, "d", "02"), (9, "n", None)]
    assert run((1, "A", None)) == [(1, "A", None), (2, "b", None), (3, "C", "01"), (4, "d", "02"), (9, "n", None)]


def test_a_broken_replacement_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "b")
    run = _merger(spark, path, "k bigint, v string, p int")
    run((1, "a", 1), (2, "b", 2))
    real = tables._finish_replacement
    calls = []

    def dies(spark, path, partition):
        calls.append(1)
        if len(calls) == 2:  # staged completely; then half of the table is gone
            files.delete(spark, f"{path}/p=1")
            raise RuntimeError("lost")
        real(spark, path, partition)

    monkeypatch.setattr(tables, "_finish_replacement", dies)
    with pytest.raises(RuntimeError):
        run((1, "A", 1), (2, "B", 2))
    monkeypatch.setattr(tables, "_finish_replacement", real)
    assert run((1, "A", 1), (2, "B", 2)) == [(1, "A", 1), (2, "B", 2)]
    assert not (tmp_path / "b" / tables.STAGING).exists()


def test_compaction_and_retention(spark, tmp_path):
    path = str(tmp_path / "c")
    for i in range(10):
        spark.createDataFrame([(i, 1), (i, None if i < 3 else 2)], "k int, p int").coalesce(1).write.mode("append").partitionBy("p").parquet(path)
    before = rows(tables.read_table(spark, path))
    partition = spark.createDataFrame([], "p int").schema["p"]
    assert tables.compact_partitions(spark, path, partition, more_than=8) == [1]
    assert rows(tables.read_table(spark, path)) == before
    assert len(list((tmp_path / "c" / "p=1").glob("*.parquet"))) == 1
    snapshots = str(tmp_path / "s")
    for i in range(4):
        tables.write_snapshot(spark.range(i), snapshots)
    assert tables.expire_snapshots(spark, snapshots) == []
    assert tables.expire_snapshots(spark, snapshots, older_than_hours=-1, keep=2) == [0, 1]
    assert tables.expire_snapshots(spark, snapshots, older_than_hours=-1, keep=0) == [2]
    assert tables.read_snapshot(spark, snapshots).count() == 3


def test_a_sales_batch_leaves_its_table_alone(spark, tmp_path):
    """What a day writes for its own steps is gone when the day is done."""
    import os

    from tiffinlake.plans import entities as en
    from tiffinlake.plans import jobs

    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared)) if os.path.exists(shared) else set()
    lake = jobs.Lake(str(tmp_path))
    for day in ("2024-01-01", "2024-01-02"):
        batch = spark.sql(f"SELECT 1L order_id, timestamp '{day}' order_date, timestamp '{day}' modified_dt, timestamp '2024-01-01' created_dt, '{day}' status")
        jobs.store_batch(spark, lake, en.ORDERS, batch, day)
    assert jobs.read_silver(spark, lake, en.ORDERS).count() == 1
    assert not [n for n in set(os.listdir(shared)) - before if n.startswith("batch-")]

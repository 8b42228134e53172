from pyspark.sql import functions as F

from helpers import rows, ts
from tiffinlake.plans import entities as en
from tiffinlake.plans.silver import to_silver
from tiffinlake.sources import tables
from tiffinlake.sources.raw import text_schema
from tiffinlake.streaming.feeds import append_feed, stream_append, stream_upsert

HEADER = ",".join(en.ORDERS.raw_columns) + "\n"


def order(key, status, when):
    return f"{key},1,1,2024-01-01T10:00:00,10,{status},UPI,2024-01-01T10:00:00,{when}\n"


def test_each_file_is_consumed_once(spark, tmp_path):
    landing, sink, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    landing.mkdir()

    def run():
        stream_append(append_feed(spark, str(landing), text_schema(["k", "v"])), sink, checkpoint).awaitTermination()
        return rows(spark.read.parquet(sink))

    (landing / "a.csv").write_text("k,v\n1,x\n2,\\N\n")
    assert run() == [("1", "x"), ("2", None)]
    assert run() == [("1", "x"), ("2", None)]
    (landing / "b.csv").write_text("k,v\n1,x\n")
    assert run() == [("1", "x"), ("1", "x"), ("2", None)]


def upsert_run(spark, tmp_path, checkpoint="cp", **options):
    query = stream_upsert(
        spark, str(tmp_path / "in"), text_schema(en.ORDERS.raw_columns), str(tmp_path / "orders"), "order_id",
        str(tmp_path / checkpoint), order_by="modified_dt", transform=lambda b: to_silver(b, en.ORDERS), **options,
    )
    query.awaitTermination()
    return rows(tables.read_snapshot(spark, str(tmp_path / "orders")), "order_id", "status", "modified_dt")


def test_upsert_from_a_feed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text(
        HEADER + order(1, "Placed", "2024-01-01T10:00:00") + order(1, "Packed", "2024-01-01T11:00:00")
        + order(2, "Placed", "2024-01-01T10:00:00")
    )
    assert upsert_run(spark, tmp_path) == [
        (1, "Packed", ts("2024-01-01T11:00:00")), (2, "Placed", ts("2024-01-01T10:00:00")),
    ]
    (tmp_path / "in" / "2.csv").write_text(HEADER + order(2, "Delivered", "2024-01-02T10:00:00"))
    expected = [(1, "Packed", ts("2024-01-01T11:00:00")), (2, "Delivered", ts("2024-01-02T10:00:00"))]
    assert upsert_run(spark, tmp_path) == expected
    versions = tables.snapshot_versions(spark, str(tmp_path / "orders"))
    assert upsert_run(spark, tmp_path) == expected
    assert tables.snapshot_versions(spark, str(tmp_path / "orders")) == versions, "nothing new, nothing written"


def test_repeating_a_batch_rewrites_the_same_version(spark, tmp_path):
    """A lost checkpoint replays the micro-batches: same version numbers, same content."""
    (tmp_path / "in").mkdir()
    for i, status in enumerate(["Placed", "Delivered"]):
        (tmp_path / "in" / f"{i}.csv").write_text(HEADER + order(1, status, f"2024-01-0{i + 1}T10:00:00"))
    first = upsert_run(spark, tmp_path, "cp1", max_files=1)
    versions = tables.snapshot_versions(spark, str(tmp_path / "orders"))
    assert versions == [1, 2]
    assert upsert_run(spark, tmp_path, "cp2", max_files=1) == first
    assert tables.snapshot_versions(spark, str(tmp_path / "orders")) == versions


def test_partitioned_target(spark, tmp_path):
    """A micro-batch rewrites the months it affects; a replay changes nothing."""
    (tmp_path / "in").mkdir()
    target = tmp_path / "orders"

    def run(checkpoint):
        stream_upsert(
            spark, str(tmp_path / "in"), text_schema(en.ORDERS.raw_columns), str(target), "order_id",
            str(tmp_path / checkpoint), order_by="modified_dt", partition_by="month",
            transform=lambda b: to_silver(b, en.ORDERS).withColumn("month", F.month("modified_dt")),
        ).awaitTermination()
        return rows(tables.read_table(spark, str(target)), "order_id", "status", "month")

    (tmp_path / "in" / "1.csv").write_text(
        HEADER + order(1, "Placed", "2024-01-01T10:00:00") + order(2, "Placed", "2024-02-01T10:00:00")
    )
    assert run("cp") == [(1, "Placed", 1), (2, "Placed", 2)]
    february = sorted(p.name for p in (target / "month=2").iterdir())
    (tmp_path / "in" / "2.csv").write_text(HEADER + order(1, "Delivered", "2024-01-02T10:00:00"))
    assert run("cp") == [(1, "Delivered", 1), (2, "Placed", 2)]
    assert sorted(p.name for p in (target / "month=2").iterdir()) == february
    assert run("other") == [(1, "Delivered", 1), (2, "Placed", 2)]

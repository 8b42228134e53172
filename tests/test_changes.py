import pytest
from pyspark.sql import functions as F

from helpers import rows
from tiffinlake.operators.change_feed import change_feed
from tiffinlake.sources import files, tables
from tiffinlake.streaming import changes

SCHEMA = "k long, v string"


def state(spark, pairs):
    return spark.createDataFrame(list(pairs.items()), SCHEMA)


def log_rows(spark, log):
    return rows(changes.read_log(spark, log), "k", "v", "action", "is_update", "from_version", "to_version")


class Feed:
    def __init__(self, spark, tmp_path):
        self.spark, self.path = spark, tmp_path
        self.source, self.sink = str(tmp_path / "source"), str(tmp_path / "sink")

    def publish(self, pairs):
        return changes.publish(state(self.spark, pairs), self.source)

    def run(self, apply=changes.log_changes, checkpoint="cp"):
        changes.consume_changes(self.spark, self.source, self.sink, "k", str(self.path / checkpoint), apply).awaitTermination()


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_net_changes_since_the_version_seen(spark, feed):
    feed.publish({1: "a", 2: "b"})
    feed.run()
    first = [(1, "a", "INSERT", False, None, 0), (2, "b", "INSERT", False, None, 0)]
    assert log_rows(spark, feed.sink) == first
    feed.run()
    assert log_rows(spark, feed.sink) == first
    feed.publish({1: "x", 2: "b", 3: "c"})
    feed.publish({1: "y", 2: "b"})  # row 3 came and went, row 1 changed twice
    feed.run()
    second = [(1, "a", "DELETE", True, 0, 2), (1, "y", "INSERT", True, 0, 2)]
    assert log_rows(spark, feed.sink) == sorted(first + second, key=repr)
    feed.run(checkpoint="another")  # a lost checkpoint repeats nothing
    assert log_rows(spark, feed.sink) == sorted(first + second, key=repr)


@pytest.mark.parametrize("when", ["before", "after"])
def test_failure_repeats_and_loses_nothing(spark, feed, monkeypatch, when):
    feed.publish({1: "a"})
    feed.run()
    feed.publish({1: "b"})
    real, failed = tables.write_snapshot, []

    def write(df, path, version=None, partition_by=None):
        if path == feed.sink and not failed:
            failed.append(path)
            if when == "after":  # the rows are there, the stream's checkpoint doesn't know
                real(df, path, version)
            raise RuntimeError("lost")
        return real(df, path, version, partition_by)

    monkeypatch.setattr(tables, "write_snapshot", write)
    with pytest.raises(Exception, match="lost"):
        feed.run()
    feed.publish({1: "b", 2: "c"})  # more arrives before the restart
    feed.run()
    assert sorted(r[:4] for r in log_rows(spark, feed.sink)) == [
        (1, "a", "DELETE", True), (1, "a", "INSERT", False), (1, "b", "INSERT", True), (2, "c", "INSERT", False),
    ]


def test_replica_follows_its_source(spark, feed):
    states = [{}, {1: "a", 2: "b"}, {2: "b", 3: None}, {2: "x", 3: "y", 4: "z"}, {}]
    for pairs in states:
        feed.publish(pairs)
        feed.run(changes.replicate("k"))
        assert rows(tables.read_snapshot(spark, feed.sink)) == rows(state(spark, pairs))
    assert tables.snapshot_versions(spark, feed.sink) == [0, 1, 2, 3, 4]


def test_versions_published_without_announcement_are_found(spark, feed):
    feed.publish({1: "a"})
    feed.run()
    tables.write_snapshot(state(spark, {1: "b"}), feed.source)
    assert changes.ANNOUNCED in files.child_names(spark, feed.source)
    feed.run()
    assert sorted(r[-1] for r in log_rows(spark, feed.sink)) == [0, 1, 1]
    assert changes.announce(spark, feed.source) == []


def test_an_expired_version_is_an_error_not_a_gap(spark, feed):
    feed.publish({1: "a"})
    feed.run()
    for v in "bc":
        feed.publish({1: v})
    assert tables.expire_snapshots(spark, feed.source, older_than_hours=-1) == [0, 1]
    with pytest.raises(Exception, match="expired"):
        feed.run()


def test_feed_of_two_states_is_the_change_feed(spark, feed):
    before, after = {i: str(i % 3) for i in range(50)}, {i: str(i % 4) for i in range(10, 60)}
    feed.publish(before)
    feed.publish(after)
    got = changes.changes_between(spark, feed.source, 0, 1, "k")
    assert rows(got) == rows(change_feed(state(spark, before), state(spark, after), "k"))
    assert changes.changes_between(spark, feed.source, None, 1, "k").filter(F.col("action") != "INSERT").isEmpty()

"""Dimension history: the worked examples, and properties any history must have."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import CSV, drop_file, rows, ts
from tiffinlake.operators import scd2
from tiffinlake.operators.change_feed import change_feed, version_diff
from tiffinlake.operators.timeline import scd2_history
from tiffinlake.plans import entities as en
from tiffinlake.plans.silver import to_silver
from tiffinlake.sources.raw import read_raw

DIM = "customer_id bigint, name string, city string"
TRACKING = ["name", "city"]
T = ["2024-01-01 00:00:00", "2024-02-01 00:00:00", "2024-03-01 00:00:00", "2024-04-01 00:00:00"]


def customers(spark, *values):
    return spark.createDataFrame(list(values), DIM)


def apply(source, dim, when, **options):
    return scd2.apply_scd2(source, dim, "customer_id", "customer_hk", TRACKING, when, **options)


def validity(dim):
    return rows(dim, "customer_id", "name", "city", "eff_start_date", "eff_end_date", "is_current")


@pytest.mark.parametrize("entity", en.DIMENSIONS, ids=lambda e: e.name)
def test_update(spark, tmp_path, entity):
    """First line opens a version, second one closes it at its modification time and opens the next."""
    versions = []
    for day, line in enumerate(CSV[entity.name]):
        folder = drop_file(tmp_path / str(day), entity, [line])
        versions.append(to_silver(read_raw(spark, folder, entity.raw_columns, f"2023-01-0{day + 1}"), entity))
    dim = None
    for batch in versions:
        dim = scd2.apply_scd2(
            batch, dim, list(entity.keys), entity.surrogate, list(entity.tracking), F.col(entity.modified),
            entity.start, entity.end, entity.flag,
        )
    expired, current = dim.orderBy(entity.start).collect()
    first, second = (v.collect()[0] for v in versions)
    assert expired[entity.start] == first[entity.modified]
    assert expired[entity.end] == second[entity.modified] == current[entity.start]
    assert current[entity.end] is None and current[entity.flag] and not expired[entity.flag]
    assert expired[entity.surrogate] != current[entity.surrogate]
    for c in entity.tracking:
        assert (expired[c], current[c]) == (first[c], second[c])


def test_new_changed_unchanged_missing(spark):
    dim = apply(customers(spark, (1, "A", "x"), (2, "B", "x"), (3, "C", None), (4, "D", "x")), None, T[0])
    batch = customers(spark, (1, "A", "y"), (2, "B", "x"), (3, "C", None), (5, "E", "x"))
    assert rows(scd2.classify(batch, dim, "customer_id", TRACKING)) == [
        (1, "CHANGED"), (2, "UNCHANGED"), (3, "UNCHANGED"), (4, "MISSING"), (5, "NEW"),
    ]
    assert rows(scd2.changed_rows(batch, dim, "customer_id", TRACKING)) == [(1, "A", "y")]
    assert rows(scd2.new_rows(batch, dim, "customer_id")) == [(5, "E", "x")]
    after = apply(batch, dim, T[1])
    assert validity(after) == sorted(
        [
            (1, "A", "x", ts(T[0]), ts(T[1]), False),
            (1, "A", "y", ts(T[1]), None, True),
            (2, "B", "x", ts(T[0]), None, True),
            (3, "C", None, ts(T[0]), None, True),
            (4, "D", "x", ts(T[0]), None, True),
            (5, "E", "x", ts(T[1]), None, True),
        ],
        key=repr,
    )
    assert rows(scd2.scd2_metrics(after, T[1])) == [(2, 1)]
    assert rows(apply(batch, after, T[2])) == rows(after), "the same batch again changes nothing"


def test_null_to_value_and_shifted_nulls_are_changes(spark):
    dim = apply(customers(spark, (1, None, "a"), (2, "a", None), (3, None, None)), None, T[0])
    after = apply(customers(spark, (1, "a", None), (2, None, "a"), (3, None, "b")), dim, T[1])
    assert after.count() == 6 and after.select("customer_hk").distinct().count() == 6


def test_several_rows_per_key_in_a_batch(spark):
    df = spark.createDataFrame([(1, "A", "x", 1), (1, "B", "x", 2), (1, None, "x", None)], DIM + ", v int")
    dim = apply(df, None, T[0], order_by="v")
    assert rows(dim, "customer_id", "name") == [(1, "B")]


def test_large_batches_take_the_full_join(spark):
    """The same result whether or not the batch is small enough to broadcast."""
    dim = apply(customers(spark, *[(i, f"n{i}", "x") for i in range(200)]), None, T[0])
    batch = customers(spark, *[(i, f"n{i}", "y" if i % 3 else "x") for i in range(100, 300)])
    small = rows(apply(batch, dim, T[1]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(apply(batch, dim, T[1])) == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_delete_and_reactivation(spark):
    dim = apply(customers(spark, (7, "Anneli", "x"), (8, "Odd", "y")), None, T[0])
    request = spark.createDataFrame(
        [(7, "moved away", ts("2024-03-04 08:15:00")), (7, "again", ts("2024-03-05 00:00:00"))],
        "customer_id bigint, delete_reason string, delete_timestamp timestamp",
    )
    gone = scd2.scd2_delete(dim, request, "customer_id")
    columns = ["customer_id", "eff_end_date", "is_current", "is_deleted", "delete_reason"]
    assert rows(gone, *columns) == [
        (7, ts("2024-03-04 08:15:00"), False, True, "moved away"),
        (8, None, True, False, None),
    ]
    back = apply(customers(spark, (7, "Anneli", "x"), (8, "Odd", "y")), gone, T[3])
    assert rows(back, *columns) == sorted(
        rows(gone, *columns) + [(7, None, True, False, None)], key=repr
    )


def replayed(spark, seed, keys=6, batches=5):
    """Random batches of changes, each key at most once per batch."""
    rng = random.Random(seed)
    out = []
    for b in range(batches):
        picked = [k for k in range(keys) if rng.random() < 0.7]
        out.append([(k, rng.choice(["a", "b", None]), rng.choice(["x", "y"])) for k in picked])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_replay_in_one_pass_equals_batch_by_batch(spark, seed):
    batches = replayed(spark, seed)
    dim, events = None, []
    for b, batch in enumerate(batches):
        when = f"2024-01-{b + 1:02d} 00:00:00"
        dim = apply(customers(spark, *batch), dim, when) if batch else dim
        events += [(*row, ts(when)) for row in batch]
    log = spark.createDataFrame(events, DIM + ", at timestamp")
    once = scd2_history(log, "customer_id", TRACKING, "at", "customer_hk", distinct_times=True)
    columns = ["customer_hk", "customer_id", "name", "city", "eff_start_date", "eff_end_date", "is_current"]
    assert rows(dim, *columns) == rows(once, *columns)
    current = dim.filter("is_current")
    assert current.count() == current.select("customer_id").distinct().count()
    overlaps = dim.alias("a").join(
        dim.alias("b"),
        F.expr("a.customer_id = b.customer_id AND a.customer_hk < b.customer_hk"
               " AND a.eff_start_date < coalesce(b.eff_end_date, timestamp'9999-01-01')"
               " AND b.eff_start_date < coalesce(a.eff_end_date, timestamp'9999-01-01')"),
    )
    assert overlaps.count() == 0


def test_change_feed_pairs(spark):
    before = customers(spark, (1, "A", "x"), (2, "B", None), (3, "C", "z"))
    after = customers(spark, (1, "A", "x"), (2, "B", "y"), (4, "D", "w"))
    assert rows(change_feed(before, after, "customer_id")) == sorted(
        [
            (2, "B", None, "DELETE", True),
            (2, "B", "y", "INSERT", True),
            (3, "C", "z", "DELETE", False),
            (4, "D", "w", "INSERT", False),
        ],
        key=repr,
    )


def test_feed_then_apply_reproduces_the_state(spark):
    states = [
        customers(spark, (1, "A", "x"), (2, None, "x"), (3, "C", "x")),
        customers(spark, (1, "A", "y"), (2, None, "x"), (4, "D", "x")),
        customers(spark, (1, "A", "x"), (2, "B", "x"), (3, "C", "x")),
    ]
    dim, previous = None, customers(spark).filter("false")
    for when, state in zip(T, states):
        feed = change_feed(previous, state, "customer_id")
        dim = scd2.apply_changes_scd2(dim, feed, "customer_id", "customer_hk", TRACKING, when)
        assert rows(dim.filter("is_current"), "customer_id", *TRACKING) == rows(state)
        previous = state
    # Customer 3 left and came back: two versions with a gap between them.
    assert validity(dim.filter("customer_id = 3")) == [
        (3, "C", "x", ts(T[0]), ts(T[1]), False), (3, "C", "x", ts(T[2]), None, True),
    ]


def test_version_diff_is_a_set_comparison(spark):
    a = customers(spark, (1, "A", "x"), (1, "A", "x"), (2, None, "x"), (3, "C", "x"))
    b = customers(spark, (1, "A", "x"), (2, None, "x"), (3, "C", "y"), (3, "C", "y"))
    assert rows(version_diff(a, b, "1", "2")) == [
        ("Only in Version 1", 3, "C", "x"), ("Only in Version 2", 3, "C", "y"),
    ]


def test_match_all_attributes_is_null_safe(spark):
    left = customers(spark, (1, "A", None), (2, "B", "x"))
    right = customers(spark, (1, "A", None), (1, "A", None), (2, "B", "y"))
    assert rows(scd2.match_all_attributes(left, right, left.columns)) == [(1, "A", None)]


def test_late_and_repeated_batches_change_nothing(spark):
    first = apply(customers(spark, (1, "new", "x"), (2, "b", "y")), None, T[1])
    late = apply(customers(spark, (1, "old", "x"), (2, "b", "y"), (3, "c", "z")), first, T[0])
    got = rows(late, "customer_id", "name", "eff_end_date", "is_current")
    assert got == [(1, "new", None, True), (2, "b", None, True), (3, "c", None, True)]
    again = apply(customers(spark, (1, "other", "x")), first, T[1])
    assert rows(again) == rows(first)
    assert late.filter("eff_end_date < eff_start_date").count() == 0

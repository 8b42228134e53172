import random

import pytest

from helpers import rows, ts
from tiffinlake.operators import splice
from tiffinlake.operators.scd2 import scd2_delete
from tiffinlake.operators.splice import splice_scd2, unplaceable
from tiffinlake.operators.timeline import scd2_history

SCHEMA = "k long, color string, size int, at timestamp"
COLUMNS = ["k", "color", "size", "eff_start_date", "eff_end_date", "is_current"]


def at(minute):
    return ts("2024-01-01T00:00:00").replace(hour=minute // 60, minute=minute % 60)


def batch(spark, events):
    return spark.createDataFrame([(k, c, s, at(m) if isinstance(m, int) else m) for k, c, s, m in events], SCHEMA)


def run(spark, batches, dim=None, repeats=None, **options):
    """The dimension after some batches, each stored, so that plans stay short."""
    for events in batches:
        dim, repeats = splice_scd2(batch(spark, events), dim, repeats, "k", "hk", ["color", "size"], "at", **options)
        dim, repeats = splice.stored(dim, "dim"), splice.stored(repeats, "repeats")
    return dim, repeats


def replayed(spark, events):
    return rows(scd2_history(batch(spark, events), "k", ["color", "size"], "at", "hk"), "hk", *COLUMNS)


def test_a_late_row_cuts_the_version_it_falls_into(spark):
    dim, _ = run(spark, [[(1, "red", 1, 10), (1, "blue", 1, 30)], [(1, "green", 1, 20)]])
    assert rows(dim, "color", "eff_start_date", "eff_end_date", "is_current") == sorted(
        [("red", at(10), at(20), False), ("green", at(20), at(30), False), ("blue", at(30), None, True)], key=repr
    )


def test_a_delivery_that_changed_nothing_may_open_a_version_later(spark):
    dim, repeats = run(spark, [[(1, "red", 1, 10)], [(1, "red", 1, 30)]])
    assert rows(dim, "color", "eff_start_date") == [("red", at(10))] and rows(repeats, "eff_start_date") == [(at(30),)]
    dim, repeats = run(spark, [[(1, "blue", 1, 20)]], dim, repeats)
    assert rows(dim, *COLUMNS) == replayed_columns(spark, [(1, "red", 1, 10), (1, "red", 1, 30), (1, "blue", 1, 20)])
    assert repeats.isEmpty()


def replayed_columns(spark, events):
    return sorted((r[1:] for r in replayed(spark, events)), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_any_order_of_batches_equals_replaying_all(spark, seed):
    rng = random.Random(seed)
    events = [(rng.randint(1, 6), rng.choice(["red", "blue", None]), rng.choice([1, None]), rng.randint(0, 60)) for _ in range(80)]
    rng.shuffle(events)
    cuts = sorted(rng.sample(range(1, 80), 3))
    batches = [events[a:b] for a, b in zip([0, *cuts], [*cuts, 80], strict=True)]
    batches.append(batches[1])  # and one comes twice
    options = {"share": 0.05, "min_rows": 3} if seed == 2 else {}  # keys cut along time
    dim, repeats = run(spark, batches, **options)
    assert rows(dim, "hk", *COLUMNS) == replayed(spark, events)
    known = {(k, m) for k, _, _, m in events}
    assert {(r.k, r.eff_start_date) for r in repeats.collect()} | {(r.k, r.eff_start_date) for r in dim.collect()} == {(k, at(m)) for k, m in known}


def test_deletes_stay_where_they_are(spark):
    dim, repeats = run(spark, [[(1, "red", 1, 10), (2, "red", 1, 10)]])
    request = spark.createDataFrame([(1, "closed", at(30))], "k long, delete_reason string, delete_timestamp timestamp")
    dim = splice.stored(scd2_delete(dim, request, "k"), "dim")
    columns = ["color", "eff_start_date", "eff_end_date", "is_current", "is_deleted", "delete_reason"]
    dim, repeats = run(spark, [[(1, "blue", 1, 20)]], dim, repeats)
    assert rows(dim.filter("k = 1"), *columns) == sorted(
        [("red", at(10), at(20), False, False, None), ("blue", at(20), at(30), False, True, "closed")], key=repr
    )
    dim, repeats = run(spark, [[(1, "blue", 1, 50), (1, "red", 1, 40)]], dim, repeats)  # back again
    assert rows(dim.filter("k = 1"), *columns) == sorted(
        [
            ("red", at(10), at(20), False, False, None), ("blue", at(20), at(30), False, True, "closed"),
            ("red", at(40), at(50), False, False, None), ("blue", at(50), None, True, False, None),
        ],
        key=repr,
    )
    assert rows(dim.filter("k = 2"), *columns) == [("red", at(10), None, True, False, None)]


def test_only_what_a_row_can_touch_is_replayed(spark, monkeypatch):
    dim, repeats = run(spark, [[(k, c, 1, m) for k in range(50) for m, c in enumerate("abcdefgh")]])
    seen = {}
    real = splice.stored
    monkeypatch.setattr(splice, "stored", lambda df, name: seen.setdefault(name, real(df, name)))
    found, _ = splice_scd2(batch(spark, [(7, "x", 1, 6)]), dim, repeats, "k", "hk", ["color", "size"], "at")
    assert rows(seen["splice-touched"], "k", "color") == [(7, "f"), (7, "g"), (7, "h")]
    assert found.count() == 400 and found.filter("color = 'x'").count() == 1


def test_rows_without_key_or_time_and_empty_batches(spark):
    events = [(None, "red", 1, 5), (1, "red", 1, None), (1, "blue", 1, 7)]
    dim, repeats = run(spark, [events])
    assert rows(dim, "k", "color") == [(1, "blue")]
    assert rows(unplaceable(batch(spark, events), "k", "at"), "k", "color") == [(1, "red"), (None, "red")]
    again, _ = run(spark, [[]], dim, repeats)
    assert rows(again) == rows(dim)
    assert run(spark, [[]])[0].isEmpty()

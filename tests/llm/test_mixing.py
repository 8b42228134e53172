import random
from collections import defaultdict

import pytest
from brute import WORDS
from tiffinlake.llm import mixing

SCHEMA = "doc_id long, source string, text string, size string, block int, target int"


def table(spark, rows):
    return mixing.with_row(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).coalesce(3))


def targets(sizes):
    """Shares by weight 1, 2, 3, capped at three times the size, the excess shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and left * weight[s] / rest > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else left * weight[s] / rest for s in names}
        full |= over


def corpus():
    rng = random.Random(4)
    rows = [(i, rng.choice(["b", "a", "é", "Z", None, "big", "big", "big"]), "w " * rng.choice([0, 1, 5, 80, 300])) for i in range(1500)]
    return rows + [(5000, "big", "w " * 90_000), (5001, "tiny", "one two"), (5002, "none", None), (5002, "none", None), (None, "a", "x y")]


def test_mix_meets_its_targets(spark):
    rows = corpus()
    got = mixing.mix(table(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, len(WORDS.findall(t or ""))) for i, _, t in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, 0.002 * want[s]), s
    again = mixing.mix(table(spark, rows)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_chunks_do_not_change_the_result(spark, monkeypatch):
    rows = corpus()
    want = sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(table(spark, rows)).collect())
    monkeypatch.setattr(mixing, "CHUNK_DOCS", 10)
    monkeypatch.setattr(mixing, "CHUNK_SLOTS", 64)
    assert sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(table(spark, rows)).collect()) == want


def test_schedule_is_spread_evenly(spark):
    docs = mixing.mix  # the schedule of a small mix: any stretch holds the sources nearly in their shares
    assert docs
    sized = spark.createDataFrame([("a", 40_000), ("b", 40_000), ("c", 40_000)], "source string, size long")
    sources = mixing.source_targets(sized)
    slots = [r["rank"] for r in mixing.schedule(sources).orderBy("slot").collect()]
    share = {r["rank"]: r["slots"] for r in sources.collect()}
    total = sum(share.values())
    for low in range(0, total - 300, 150):
        for rank, n in share.items():
            assert abs(slots[low : low + 300].count(rank) - 300 * n / total) <= 6


def test_tiny_sources_get_all_their_slots(spark):
    tiny = [(f"s{i:03}", 1 + i % 5) for i in range(120)]
    sized = spark.createDataFrame([*tiny, ("large", mixing.BLOCK_WORDS * 300_000)], "source string, size long")
    sources = mixing.source_targets(sized).cache()
    want = {r["rank"]: r.slots for r in sources.collect()}
    assert sorted(want.values())[:-1] == sorted(3 * n for _, n in tiny)  # capped at three passes over one-word blocks
    found = mixing.schedule(sources).groupBy("rank").agg({"turn": "max", "*": "count"}).collect()
    assert {r["rank"]: r["count(1)"] for r in found} == want and all(r["max(turn)"] == want[r["rank"]] - 1 for r in found)


def test_odd_tables(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    got = mixing.mix(table(spark, [(1, None, None), (1, None, ""), (2, "a", " \t")])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 3

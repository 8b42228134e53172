import numpy as np
import pytest
from pyspark.sql import functions as F
from tiffinlake.llm import blocks, mih, pivots

SCHEMA = "vec_id long, embedding array<float>, score int, lane string, vector int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in vectors], SCHEMA)


def normal(n, dims, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) + 2 * rng.normal(size=(7, dims))[rng.integers(0, 7, n)]
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def brute(ids, x, every, k):
    out = {}
    for i in range(len(ids)):
        if ids[i] % every == 0:
            s = x @ x[i]
            others = [j for j in np.lexsort((ids, -s)) if j != i][:k]
            out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in others]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


ODD = [(100_000, None), (100_001, [1.0, None, 0.5, 1.0, 1.0, 1.0]), (100_050, [float("nan")] * 6), (100_100, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (100_150, [1.0] * 5)]


def test_top_k_is_exact(spark):
    x = normal(900, 6)
    x[300:420] = x[300]  # ties and copies
    ids = np.arange(900)
    got = found(pivots.top_k(table(spark, [*zip(ids.tolist(), x.tolist(), strict=True), *ODD]), every=50, k=5))
    assert got == brute(ids, np.floor(256 * x.astype(np.float64)), 50, 5)


@pytest.mark.parametrize("vectors", [[], [(0, [0.5, 1.0])], [(0, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [0.0, 0.0])], [(0, None)]])
def test_few_vectors(spark, vectors):
    got = found(pivots.top_k(table(spark, vectors), every=50, k=5))
    near = found(mih.nearest(table(spark, vectors), every=20, k=20))
    others = len(vectors) - 1
    assert {k: len(v) for k, v in got.items()} == ({0: others} if others > 0 else {})
    assert {k: len(v) for k, v in near.items()} == ({0: 1} if others > 0 else {})  # a zero vector takes no part


def test_recall_and_scores(spark):
    x = normal(3000, 32)
    x[1000:1040] = x[1000]
    ids = np.arange(3000) * 2
    got = found(mih.nearest(table(spark, [*zip(ids.tolist(), x.tolist(), strict=True), *ODD]), every=20, k=20))
    want = brute(ids, x.astype(np.float64), 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    place = {int(i): n for n, i in enumerate(ids)}
    for q, rows in got.items():
        for v, s in rows:
            assert abs(s - float(x[place[q]].astype(np.float64) @ x[place[v]].astype(np.float64))) < 1e-12
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))


def test_queries_with_too_few_finds_are_searched_exactly(spark, monkeypatch):
    real = mih.fit
    monkeypatch.setattr(mih, "fit", lambda *a: real(*a)._replace(radius=0))
    x = np.random.default_rng(1).normal(size=(300, 16)).astype(np.float32)  # hardly any code twice
    got = found(mih.nearest(table(spark, [*zip(range(300), x.tolist(), strict=False)]), every=20, k=20))
    want = brute(np.arange(300), x.astype(np.float64), 20, 20)
    assert {q: [a for a, _ in v] for q, v in got.items()} == {q: [a for a, _ in v] for q, v in want.items()}


def test_pigeonhole_radii():
    for bits, radius in ((64, 30), (64, 28), (32, 5), (10, 3), (64, 0)):
        radii = mih.substring_radii(bits, radius)
        # However a difference of radius + 1 bits avoids all tables, it needs one bit more per substring.
        assert sum(r + 1 for r in radii) == radius + 1


def test_repeated_query_blocks_are_shuffled_whatever_their_estimate(spark):
    x = normal(400, 6)
    rows = blocks.usable(table(spark, [*zip(range(400), x.tolist(), strict=True)]))
    q = blocks.pack(blocks.query_rows(rows, 50), blocks.QUERIES, 8, lambda m: [m])
    got = blocks.best(q, blocks.pack(rows, blocks.ROWS, 8, lambda m: [m]), 8, 5, mih.exact)
    assert {i: [a for a, _ in v] for i, v in found(got).items()} == {
        i: [a for a, _ in v] for i, v in brute(np.arange(400), x.astype(np.float64), 50, 5).items()
    }
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_sample_reaches_the_driver_once(spark):
    """Not once per partition, and it is the same vectors."""
    x = normal(6000, 4)
    rows = blocks.usable(table(spark, [*zip(range(6000), x.tolist(), strict=True)])).repartition(16)
    want = np.array([r.vector for r in rows.orderBy(F.xxhash64("vec_id")).collect()])
    collected = []
    real = type(rows).orderBy
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(rows), "orderBy", lambda df, *by: collected.append(df) or real(df, *by))
        got = {n: blocks.bounded_sample(rows, n) for n in (0, 1, 500, 6000, 9000)}
    for n, sample in got.items():
        assert sample.tolist() == want[:n].tolist()
    counts = [df.count() for df in collected if "vector" in df.columns]
    assert counts[1] < 20 and counts[2] < 600  # rows that any task may send, all tasks together

import random

import pytest
from brute import components, shingles
from tiffinlake.llm import ngram

SCHEMA = "doc_id long, text string, node string, component_id int, size string"


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    docs = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 40, 150, 400]))]
        if rng.random() < 0.4:
            base += passage
        docs.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 9])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(copy)
    texts = [" \n".join(d).upper() if i % 7 == 0 else " ".join(d) for i, d in enumerate(docs)]
    texts += [None, "", " \t\n", "É é", "one", "One", "one two", "x" * 300_000, "x " * 100_000]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(3 * k + 1, texts[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_like_brute_force(spark, n, percent, monkeypatch):
    docs = corpus()
    want = components(docs, n, percent)
    table = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram.join_near(table, n, percent).collect()}
    assert got == {i: (len(shingles(t, n)), want[i]) for i, t in docs}


def test_large_groups_and_dealt_grams(spark, monkeypatch):
    """Groups of many near copies whose n-grams are dealt over several tiles."""
    monkeypatch.setattr(ngram, "TILE", 16)
    rng = random.Random(2)
    docs = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(80)]
        for _ in range(120):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(copy)))
    table = spark.createDataFrame([(i, t, "", 0, "") for i, t in docs], SCHEMA).repartition(4)
    got = {r.doc_id: r.component_id for r in ngram.join_near(table, 3, 90).collect()}
    assert got == components(docs, 3, 90)


def test_odd_tables(spark):
    assert ngram.join_near(spark.createDataFrame([], SCHEMA), 3, 90).count() == 0
    rows = [(5, "a b c d", "", 0, ""), (5, "a b c d", "", 0, ""), (4, "A B C d", "", 0, ""), (None, "p q r s", "", 0, "")]
    got = ngram.join_near(spark.createDataFrame(rows, SCHEMA), 3, 90).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == [(0, 2, None), (4, 2, 4), (5, 2, 4), (5, 2, 4)]


def test_signature_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
        a, b = (np.unique(pool[rng.random(3000) < rng.random()]) for _ in range(2))
        apart = len(np.setxor1d(a, b))
        wide = [ngram.parity(x, max(128, 1 << (2 * len(x)).bit_length())) for x in (a, b)]
        assert ngram.differing(ngram.parity(a), ngram.parity(b)) <= apart and ngram.differing(*wide) <= apart


def test_postings_are_numbers_and_counts_narrow(spark):
    """What moves most: no digests or flags, the n-gram only where the tile isn't it; counts in as few bytes as hold them."""
    import numpy as np

    table = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in corpus()], SCHEMA).repartition(3)
    counted = ngram.nodes_and_counts(table, 3)
    found = {len(r.counts) for r in counted.where("slice is not null").select("counts").collect()}
    assert max(found) <= 4 * ngram.CELLS // ngram.SLICES
    classes = spark.sparkContext.broadcast(ngram.gram_classes(counted))
    posted = ngram.postings(table, 3, 90, classes)
    assert {t for _, t in posted.dtypes} == {"bigint", "int"}
    assert posted.where("gram is not null").isEmpty() and posted.where("size < 0").count() < posted.count()
    counts = [np.full(ngram.CELLS // ngram.SLICES, n) for n in (0, 255, 256, 70_000, 1 << 40)]
    assert [ngram.narrowest(c).itemsize for c in counts] == [1, 1, 2, 4, 8]
    assert all((ngram.narrowest(c) == c).all() for c in counts)

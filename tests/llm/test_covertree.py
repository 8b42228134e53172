import math

import numpy as np
import pytest
from tiffinlake.llm import covertree

SCHEMA = "vec_id long, embedding array<float>, label int, code string, of int, part long"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], schema)


def brute(rows, parts=8, entries=16, rounds=6):
    """{(id, label): sorted (code, error)} and the codebooks, by comparing every part with every entry."""
    usable = [(i, v, x) for i, v, x in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    width = -(-len(usable[0][1]) // parts)
    whole = [[math.floor(4096 * c) for c in v] + [0] * (parts * width - len(v)) for _, v, _ in usable]
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    order = sorted(range(len(usable)), key=lambda i: (usable[i][0] is None, usable[i][0] or 0, whole[i]))
    first, seen = [], set()
    for i in order:
        if usable[i][0] not in seen:
            seen.add(usable[i][0])
            first.append(i)
    books = [[cut[i][p] for i in first[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for c in cut:
                own[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(c) // len(o) for c in zip(*o, strict=True)] if o else books[p][e] for e, o in enumerate(own)]
    out = []
    for (i, _, label), c in zip(usable, cut, strict=True):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, books


def clustered(n, dims, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(5, dims))[rng.integers(0, 5, n)] + 0.2 * rng.normal(size=(n, dims))
    return (x * scale).astype(np.float32).tolist()


def compare(spark, rows):
    want, books = brute(rows)
    total = {}
    for _, label, _, error in want:
        total[label] = total.get(label, 0) + error
    got, found = covertree.compress(table(spark, rows))
    assert found == books
    key = repr
    assert sorted(map(tuple, got.select("vec_id", "label", "code", "error", "label_error").collect()), key=key) == sorted(
        [(i, x, c, e if e < 2**63 else None, total[x] if all(w[3] < 2**63 for w in want if w[1] == x) else None) for i, x, c, e in want],
        key=key,
    )


ODD = [(900, None, 1), (901, [], 2), (902, [float("nan")] * 16, 3), (903, [None] + [0.0] * 15, None), (904, [float("inf")] * 16, 1)]


def test_equal_to_comparing_all(spark):
    x = clustered(700, 16)
    x[100:300] = [x[100]] * 200  # a hot vector
    rows = [(i * 3 % 700, v, [None, 4, 5][min(i % 7, 2)]) for i, v in enumerate(x)]
    rows += [(None, x[5], 4), (0, x[7], 4), (0, x[7], 4)]
    compare(spark, rows + ODD)
    books = covertree.compress(table(spark, rows))[1]
    assert len(covertree.books_sha256(books)) == 64


def test_fewer_ids_than_entries_and_a_length_that_does_not_divide(spark):
    compare(spark, [(i % 5, v, 0) for i, v in enumerate(clustered(12, 10))])


@pytest.mark.parametrize("scale", [3e4, 1e30])
def test_components_of_any_size(spark, scale):
    compare(spark, [(i, v, i % 2) for i, v in enumerate(clustered(40, 8, scale=scale) + clustered(9, 8))])


def test_empty_tables(spark):
    for rows in ([], ODD):
        found, books = covertree.compress(table(spark, rows))
        assert books == [] and found.columns == ["vec_id", "label", "code", "error", "label_error"] and found.count() == 0


def test_trees_cover_and_assign_whole_nodes():
    rng = np.random.default_rng(3)
    points = np.floor(4096 * (rng.normal(size=(6, 3))[rng.integers(0, 6, 3000)] + 0.02 * rng.normal(size=(3000, 3))))
    tree = covertree.grow(points)
    assert sorted(tree.order) == list(range(3000))
    for node in range(len(tree.low)):
        members = points[tree.order[tree.low[node] : tree.high[node]]]
        assert covertree.distances(members, points[tree.pivot[node]]).max() == tree.radius[node]
        kids = range(tree.child[node], tree.child[node] + tree.children[node])
        pivots = points[tree.pivot[list(kids)]] if kids else []
        assert not kids or tree.pivot[node] == tree.pivot[kids[0]]
        for a in range(len(pivots)):
            assert tree.radius[kids[a]] <= tree.radius[node] / 2
            assert (covertree.distances(pivots[a + 1 :], pivots[a]) > tree.radius[node] / 2).all()
    entries = points[:16]
    codes, done, _ = covertree.nearest(tree, points, entries)
    assert (codes == covertree.squared(points[tree.order], entries).argmin(1)).all()
    assert (tree.high[done] - tree.low[done]).max() > covertree.LEAF  # subtrees were assigned by their bound

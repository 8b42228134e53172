"""Vector code compression: product codes by Lloyd's rounds over partition-local cover trees.

Components are whole numbers, floor(4096 * x), so every step is exact. Vectors are cut into ``parts``
equal parts. Where they lie, rows are packed into blocks of at most ``ROWS`` vectors, and each part of a
block becomes a cover tree: a node has a pivot, one of its points, and the distance of its farthest
point; its children's pivots, its own among them, lie more than half that distance apart and each point
is within that half of its child's pivot; up to ``LEAF`` points stay together. Points are kept in the
order of the tree with cumulative sums over them, so the sum of any subtree is one subtraction.

A round walks all nodes of a level at once. By the triangle inequality an entry farther from the pivot
than the nearest one by more than twice the node's radius is nearest to none of its points. A node left
with one entry is assigned whole; the others hand the entries left to their children, and the points of
ambiguous leaves are compared exactly. A task adds up its blocks and Spark its tasks, as whole numbers in
pieces of 30 bits; a round collects one sum per entry and component. Blocks are built once, kept in the
shared folder and read by every round.

Defined cases: vectors that are null or hold null or non-finite components, empty vectors, and vectors of
another than the most common length (ties to the shorter) are left out; a length that doesn't divide into
the parts is filled up with zeros at the end. Repeated ids are rows of their own, the least vector of an
id stands in the codebook; a null id counts as greater than all others. With fewer ids than entries the
codebook has as many entries as ids. Components of any size are exact: where squares could pass 52 bits
Python's integers take over; an error beyond 64 bits is null, and so is the error of its label. An empty
table gives no rows. Of other columns only ``label`` (of any type) is read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

SCALE, ROWS, LEAF = 4096, 4096, 16
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Squared distances below this are exact in double precision, in whatever order they are added.
EXACT = 2**52
#: Safety of bounds that come from square roots.
SLACK = 1 + 1e-9
LIMB = 30
LONGEST = 2**63 - 1


# --- whole numbers


def whole(vectors: np.ndarray, width: int, parts: int) -> np.ndarray:
    """(rows, parts, width) of floor(4096 * x): doubles where all squares are exact, else Python integers."""
    filled = np.zeros((len(vectors), parts * width))
    filled[:, : vectors.shape[1]] = vectors
    largest = float(np.abs(filled).max(initial=0))
    if width * (2.0 * (largest * SCALE + 1)) ** 2 < EXACT:
        numbers = np.floor(SCALE * filled)
    else:
        plain = [int(x) * SCALE if abs(x) >= 2**53 else math.floor(x * SCALE) for x in filled.ravel().tolist()]
        numbers = np.array(plain, object).reshape(filled.shape)
    return numbers.reshape(len(vectors), parts, width)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, points by entries; exact."""
    if points.dtype == object:
        return ((points[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    cross = points @ entries.T
    return (points * points).sum(1)[:, None] - 2 * cross + (entries * entries).sum(1)[None, :]


def same_kind(points: np.ndarray, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Points and entries as doubles if all their squared distances are exact, else as Python integers."""
    largest = max((abs(c) for e in entries for c in e), default=0)
    width = points.shape[1]
    if points.dtype != object and largest < 2**30:
        largest = max(largest, int(np.abs(points).max(initial=0)))
        if width * (2 * largest) ** 2 < EXACT:
            return points, np.array(entries, np.float64).reshape(len(entries), width)
    exact = points if points.dtype == object else points.astype(np.int64).astype(object)
    return exact, np.array(entries, object).reshape(len(entries), width)


# --- cover trees


class Tree(NamedTuple):
    """``order`` lists the points; a node owns order[low:high]; its children are numbered in sequence."""

    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray


def distances(points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - pivot) ** 2).sum(1))


def grow(points: np.ndarray) -> Tree:
    """The cover tree of some points. Python integers have no bounds here: their tree is a single leaf."""
    order = np.arange(len(points))
    if points.dtype == object:
        one = np.array([0])
        return Tree(order, one, np.array([len(points)]), one, np.array([np.inf]), one, one)
    first = distances(points, points[0])
    low, high, pivot, radius, child, children = [0], [len(points)], [0], [float(first.max())], [], []
    for node in range(10**9):
        if node == len(low):
            break
        start, end, reach = low[node], high[node], radius[node]
        child.append(len(low))
        if end - start <= LEAF or reach == 0:
            children.append(0)
            continue
        members = order[start:end]
        own = points[members]
        pivots, near, owner = [pivot[node]], distances(own, points[pivot[node]]), np.zeros(end - start, np.int64)
        while near[far := int(near.argmax())] > reach / 2:
            d = distances(own, own[far])
            closer = d < near
            owner[closer], near[closer] = len(pivots), d[closer]
            pivots.append(int(members[far]))
        sort = np.argsort(owner, kind="stable")
        order[start:end] = members[sort]
        counts = np.bincount(owner, minlength=len(pivots))
        ends = start + np.cumsum(counts)
        low += (ends - counts).tolist()
        high += ends.tolist()
        pivot += pivots
        radius += np.maximum.reduceat(near[sort], np.cumsum(counts) - counts).tolist()
        children.append(len(pivots))
    return Tree(*(np.array(x) for x in (order, low, high, pivot, radius, child, children)))


def ranges(low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """low[0], low[0] + 1, ... for each range, one after the other."""
    starts = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(low - starts, sizes)


def nearest(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry per point in tree order, nodes assigned whole, their entries); ties go to the lower entry."""
    codes = np.zeros(len(points), np.int64)
    nodes, left = np.array([0]), np.ones((1, len(entries)), bool)
    done, entry_of, unsure = [], [], []
    while len(nodes):
        radius = tree.radius[nodes]
        exact = squared(points[tree.pivot[nodes]], entries)
        reach = np.where(left, np.sqrt(exact.astype(np.float64)) if exact.dtype != object else 0.0, np.inf)
        left &= reach <= ((reach.min(1) + 2 * radius) * SLACK)[:, None]
        sure = (left.sum(1) == 1) | (radius == 0)
        first = np.where(left, exact, np.inf).argmin(1)
        done.append(nodes[sure])
        entry_of.append(first[sure])
        kids = tree.children[nodes]
        leaf = ~sure & (kids == 0)
        unsure.append(nodes[leaf])
        down = ~sure & ~leaf
        left = np.repeat(left[down], kids[down], axis=0)
        nodes = ranges(tree.child[nodes[down]], kids[down])
    done, entry_of, unsure = (np.concatenate(x) for x in (done, entry_of, unsure))
    sizes = tree.high[done] - tree.low[done]
    codes[ranges(tree.low[done], sizes)] = np.repeat(entry_of, sizes)
    at = ranges(tree.low[unsure], tree.high[unsure] - tree.low[unsure])
    if len(at):
        codes[at] = squared(points[tree.order[at]], entries).argmin(1)
    return codes, done, entry_of


class Part(NamedTuple):
    """One part position of a block: its points, their tree and the sums of the points before each place."""

    points: np.ndarray
    tree: Tree
    before: np.ndarray


def stowed(numbers: np.ndarray) -> bytes:
    """All parts of a block with their trees, as small as they are exact."""
    parts = []
    for p in range(numbers.shape[1]):
        points = np.ascontiguousarray(numbers[:, p])
        tree = tuple(x if x.dtype == float else x.astype(np.int32) for x in grow(points))
        parts.append((points if points.dtype == object else points.astype(np.int32), tree))
    return pickle.dumps(parts)


def parts_of(data: bytes) -> Iterator[Part]:
    for points, nodes in pickle.loads(data):
        tree = Tree(*nodes)
        points = points if points.dtype == object else points.astype(np.float64)
        zero = np.zeros((1, points.shape[1]), points.dtype)
        yield Part(points, tree, np.concatenate([zero, np.cumsum(points[tree.order], axis=0)]))


def sums(part: Part, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(points of each entry, their component sums as Python integers)."""
    points, centres = same_kind(part.points, entries)
    codes, done, entry_of = nearest(part.tree, points, centres)
    low, high = part.tree.low[done], part.tree.high[done]
    total = np.zeros((len(entries), points.shape[1]), part.points.dtype)
    np.add.at(total, entry_of, part.before[high] - part.before[low])
    whole_nodes = np.zeros(len(codes), bool)
    whole_nodes[ranges(low, high - low)] = True
    rest = np.flatnonzero(~whole_nodes)
    np.add.at(total, codes[rest], part.points[part.tree.order[rest]])
    counts = np.bincount(codes, minlength=len(entries))
    return counts, total if total.dtype == object else total.astype(np.int64).astype(object)


# --- on Spark


def kept(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector (doubles) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where(vector.isNotNull() & finite & (F.size(vector) > 0)).select("vec_id", "label", vector.alias("vector"))
    sizes = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("vector") == (sizes["n"] if sizes else 0))


def first_entries(vectors: DataFrame, entries: int) -> list[list[float]]:
    """The vectors of the smallest ids, ascending; ``entries`` rows at most."""
    ids = [r[0] for r in vectors.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()]
    named = F.col("vec_id").isin([i for i in ids if i is not None])
    some = vectors.where(named | F.col("vec_id").isNull() if None in ids else named)
    found = some.groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(F.asc_nulls_last("vec_id"))
    return [r["vector"] for r in found.collect()]


def blocks(vectors: DataFrame, width: int, parts: int) -> DataFrame:
    """Blocks of rows: their ids and labels, and the trees of all parts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = batch.slice(at, ROWS)
                numbers = whole(np.stack(own.column(2).to_numpy(zero_copy_only=False)), width, parts)
                packed = stowed(numbers)
                lists = [pa.ListArray.from_arrays([0, own.num_rows], pa.concat_arrays([c])) for c in own.columns[:2]]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([packed], pa.binary())], names=["ids", "labels", "block"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    ddl = f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, block binary"
    return vectors.select("vec_id", "label", "vector").mapInArrow(scan, ddl)


Books = list[list[list[int]]]


def next_books(packed: DataFrame, books: Books) -> Books:
    """One round: every entry becomes the floor of its points' mean; unused ones stay."""
    parts, entries, width = len(books), len(books[0]), len(books[0][0])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for batch in batches:
            for data in batch.column(0):
                for p, part in enumerate(parts_of(data.as_py())):
                    n, s = sums(part, books[p])
                    counts[p] += n
                    totals[p] += s
        out = []
        for p, e in np.argwhere(counts).tolist():
            out.append((p, e, -1, 0, int(counts[p, e])))
            for place, value in enumerate(totals[p, e].tolist()):
                limb = 0
                while value not in (0, -1):
                    value, low = divmod(value, 1 << LIMB)
                    out.append((p, e, place, limb, low))
                    limb += 1
                out.append((p, e, place, limb, value))
        if out:
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "place", "limb", "value"])

    found = packed.select("block").mapInArrow(scan, "part long, entry long, place long, limb long, value long")
    rows = found.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect()
    counts: dict[tuple, int] = {}
    totals: dict[tuple, int] = {}
    for part, entry, place, limb, value in rows:  # a few for every entry and component
        if place < 0:
            counts[part, entry] = value
        else:
            totals[part, entry, place] = totals.get((part, entry, place), 0) + (value << (LIMB * limb))
    return [
        [[totals[p, e, c] // counts[p, e] for c in range(width)] if (p, e) in counts else books[p][e] for e in range(entries)]
        for p in range(parts)
    ]


def coded(packed: DataFrame, books: Books, kinds: dict[str, str]) -> DataFrame:
    """vec_id, label, code, error of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = (batch.column(c)[i].values for c in range(2))
                digits, errors = [], np.zeros(len(ids), object)
                for part, book in zip(parts_of(batch.column(2)[i].as_py()), books, strict=True):
                    points, centres = same_kind(part.points, book)
                    codes = np.zeros(len(ids), np.int64)
                    codes[part.tree.order] = nearest(part.tree, points, centres)[0]
                    error = ((points - centres[codes]) ** 2).sum(1)
                    errors = errors + (error if error.dtype == object else error.astype(np.int64).astype(object))
                    digits.append(codes)
                texts = [bytes(row).hex() for row in np.stack(digits, axis=1).astype(np.uint8)]
                errors = pa.array([e if e <= LONGEST else None for e in errors.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(texts), errors], names=["vec_id", "label", "code", "error"])

    return packed.mapInArrow(scan, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """(vec_id, label, code, error, label_error per row; the codebooks: part, entry, component).

    ``rows`` has vec_id, embedding and label; ``entries`` is at most 256. Codes have two hex digits a part.
    """
    vectors = kept(rows)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    first = first_entries(vectors, entries)
    if not first:
        ddl = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, label_error long"
        return rows.sparkSession.createDataFrame([], ddl), []
    width = -(-len(first[0]) // parts)
    start = whole(np.array(first), width, parts)
    books = [[[int(c) for c in entry] for entry in start[:, p].tolist()] for p in range(parts)]
    packed = stored(blocks(vectors, width, parts), "trees")
    for _ in range(rounds):
        books = next_books(packed, books)
    found = stored(coded(packed, books, kinds), "codes")
    total = F.expr("try_cast(sum(cast(error as decimal(38, 0))) as bigint)")
    by_label = found.groupBy(F.col("label").alias("of")).agg(F.when(F.count("*") == F.count("error"), total).alias("label_error"))
    return found.join(by_label, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def books_sha256(books: Books) -> str:
    """SHA-256 of all components by part, entry and place, as decimals joined by commas."""
    numbers = ",".join(str(c) for book in books for entry in book for c in entry)
    return hashlib.sha256(numbers.encode()).hexdigest()

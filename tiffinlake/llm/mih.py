"""Approximate nearest neighbours by multi-index hashing over learned binary codes.

Vectors become codes of up to 64 bits: projected on principal axes and turned by a rotation that is
fitted so that signs lose least. A code is split into substrings of ``SUBSTRING_BITS`` bits. Two codes
within Hamming radius r must, for some substring, be within the radius that the pigeonhole principle
leaves it; so probing that many neighbours of each of a query's substrings in the substring's table
finds every code within r. A code is taken up from the first table it turns up in, its whole code
tested, and the original vectors decide among those within r by inner product. Queries that find fewer
than k are searched exactly.

Codes and radius are fitted on at most ``SAMPLE`` vectors chosen by hash of their id; r is the least
radius that finds ``RECALL`` of the true neighbours of ``TRIALS`` sample vectors within the sample.
More vectors lie closer, so recall over all rows is higher still. All rows are indexed.

Defined cases: vectors that are null, zero, of another than the most common length, or hold null or
non-finite components take no part; a query has no candidate with its own vec_id; ties go to the
smaller vec_id; with k candidates or fewer all are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import blocks
from .common import stored

SAMPLE, TRIALS, ROUNDS = 20_000, 400, 20
BITS, SUBSTRING_BITS, RECALL = 64, 4, 0.97


class Codes(NamedTuple):
    mean: np.ndarray
    turn: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """A code per vector, bit b of 2 ** b."""
        signs = (vectors - self.mean) @ self.turn > 0
        return (signs.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def fit(sample: np.ndarray, k: int, recall: float = RECALL) -> Codes:
    """Principal axes, then rounds of: nearest signs, best rotation towards them."""
    if len(sample) <= k:
        dims = sample.shape[1] if sample.ndim == 2 else 1
        return Codes(np.zeros(dims), np.eye(dims)[:, :BITS], min(dims, BITS))
    mean = sample.mean(0)
    _, axes = np.linalg.eigh(np.cov((sample - mean).T).reshape(sample.shape[1], -1))
    axes = axes[:, ::-1][:, :BITS]
    flat = (sample - mean) @ axes
    rotation = np.linalg.qr(np.random.default_rng(0).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(ROUNDS):
        u, _, v = np.linalg.svd(np.sign(flat @ rotation).T @ flat)
        rotation = (u @ v).T
    codes = Codes(mean, axes @ rotation, 0)
    own = codes.encode(sample)
    trials = min(TRIALS, len(sample))
    scores = sample[:trials] @ sample.T
    scores[np.arange(trials), np.arange(trials)] = -np.inf
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    differ = np.bitwise_count(own[:trials, None] ^ own[near])
    reached = np.cumsum(np.bincount(differ.ravel(), minlength=codes.bits + 1)) / differ.size
    return codes._replace(radius=int(np.searchsorted(reached, recall)))


def substring_radii(bits: int, radius: int, width: int = SUBSTRING_BITS) -> list[int]:
    """How far each substring is probed: by pigeonhole, one of them differs in no more bits than that.

    With m substrings and radius m * s + a, the first a + 1 are probed to s, the others to s - 1.
    """
    m = -(-bits // width)
    s, a = divmod(radius, m)
    return [s if i <= a else s - 1 for i in range(m)]


def probe(codes: Codes):
    """Search of a query block in a candidate block through the block's substring tables."""
    radii, width = substring_radii(codes.bits, codes.radius), SUBSTRING_BITS
    mask = np.uint64(2**width - 1)
    values = np.arange(2**width, dtype=np.uint64)

    def search(queries: list, candidates: list, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        q_ids, c_ids = queries[0], candidates[0]
        q, c = (np.frombuffer(side[1]).reshape(len(side[0]), -1) for side in (queries, candidates))
        q_code, c_code = (np.frombuffer(side[2], np.uint64) for side in (queries, candidates))
        hits = np.zeros((len(q_ids), len(c_ids)), bool)
        for j, r in enumerate(radii):
            if r < 0:
                continue
            shift = np.uint64(j * width)
            q_part, c_part = (q_code >> shift) & mask, (c_code >> shift) & mask
            table = np.argsort(c_part, kind="stable")  # the rows of each value, one after the other
            bounds = np.searchsorted(c_part[table], np.arange(2**width + 1, dtype=np.uint64))
            for value in values.tolist():
                rows = table[bounds[value] : bounds[value + 1]]
                askers = np.flatnonzero(np.bitwise_count(q_part ^ np.uint64(value)) <= r)
                if not len(rows) or not len(askers):
                    continue
                near = np.bitwise_count(q_code[askers, None] ^ c_code[rows]) <= codes.radius
                hits[np.ix_(askers, rows)] |= near
        for i in range(len(q_ids)):
            found = np.flatnonzero(hits[i] & (c_ids != q_ids[i]))
            yield i, found, c[found] @ q[i]

    return search


def exact(queries: list, candidates: list, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    q_ids, c_ids = queries[0], candidates[0]
    q, c = (np.frombuffer(side[1]).reshape(len(side[0]), -1) for side in (queries, candidates))
    for i in range(len(q_ids)):
        found = np.flatnonzero(c_ids != q_ids[i])
        yield i, found, c[found] @ q[i]


def nearest(rows: DataFrame, every: int, k: int, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score (inner product) for rows of vec_id, embedding.

    Queries are the rows whose vec_id is divisible by ``every``.
    """
    vectors = blocks.usable(rows).where(F.exists("vector", lambda x: x != 0))
    codes = fit(blocks.bounded_sample(vectors, SAMPLE), k, recall)

    def derive(matrix: np.ndarray) -> list[np.ndarray]:
        return [matrix, codes.encode(matrix)]

    lanes = blocks.lanes_of(vectors)
    asked = blocks.query_rows(vectors, every)
    c = blocks.pack(vectors, blocks.ROWS, lanes, derive)
    found = blocks.best(blocks.pack(asked, blocks.QUERIES, lanes, derive), c, lanes, k, probe(codes))
    found = stored(found, "found")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = asked.join(full, "vec_id", "left_anti")
    if short.isEmpty():
        return found
    rest = blocks.best(blocks.pack(short, blocks.QUERIES, lanes, derive), c, lanes, k, exact)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)

"""Exact top-k by pivot-table elimination.

Every vector's distances to many pivots are computed once, when it is packed. For a query, the largest
difference between its own distances to the pivots and a candidate's bounds their distance from below,
and with both norms the inner product from above. Candidates are evaluated in the order of that bound
until it falls below the k-th best score found; a tie with it is still evaluated, as the smaller vec_id
wins. So the result is exact whatever the pivots are.

Scores are whole numbers, exact up to 2 ** 53. Defined cases: vectors that are null, empty, of another
than the most common length, or hold null or non-finite components take no part, nor do rows without
vec_id; a query row has no candidate with its own vec_id; rows with equal ids are candidates each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from . import blocks

PIVOTS, SAMPLE = 32, 4096
#: Room for rounding in the bounds.
SLACK = 1e-6


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Vectors of the sample, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    nearest = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(count, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def eliminate(queries: list, candidates: list, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query: places and scores of candidates that include its k best of this block."""
    q_ids, c_ids = queries[0], candidates[0]
    q, c = (np.frombuffer(side[1]).reshape(len(side[0]), -1) for side in (queries, candidates))
    q_to, c_to = (np.frombuffer(side[2]).reshape(len(side[0]), -1) for side in (queries, candidates))
    q_norm, c_norm = (q**2).sum(1), (c**2).sum(1)
    table = np.ascontiguousarray(c_to.T)
    for i in range(len(q_ids)):
        lower = np.zeros(len(c_ids))
        for p in range(len(table)):
            np.maximum(lower, np.abs(table[p] - q_to[i, p]), out=lower)
        bound = (q_norm[i] + c_norm - lower**2) / 2
        bound += SLACK * (1 + np.abs(bound))
        bound[c_ids == q_ids[i]] = -np.inf
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > -np.inf)]
        scores, done, step, kth = np.empty(len(order)), 0, 4 * k, -np.inf
        while done < len(order) and bound[order[done]] >= kth:
            upto = min(len(order), done + step)
            scores[done:upto] = c[order[done:upto]] @ q[i]
            done, step = upto, 2 * step
            if done >= k:
                kth = np.partition(scores[:done], done - k)[done - k]
        yield i, order[:done], scores[:done]


def top_k(rows: DataFrame, every: int, k: int, scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score for rows of vec_id, embedding; components count as floor(scale * x).

    Queries are the rows whose vec_id is divisible by ``every``.
    """
    vectors = blocks.usable(rows)
    chosen = choose_pivots(np.floor(scale * blocks.bounded_sample(vectors, SAMPLE)), pivots)

    def derive(matrix: np.ndarray) -> list[np.ndarray]:
        whole = np.floor(scale * matrix)
        return [whole, distances(whole, chosen)]

    lanes = blocks.lanes_of(vectors)
    q = blocks.pack(blocks.query_rows(vectors, every), blocks.QUERIES, lanes, derive)
    c = blocks.pack(vectors, blocks.ROWS, lanes, derive)
    return blocks.best(q, c, lanes, k, eliminate)

"""A stated query set against all rows of vectors, block by block.

Candidates are packed where they lie into blocks of at most ``ROWS`` vectors, queries into blocks of at
most ``QUERIES``. Each candidate block meets each query block once: query blocks are repeated for every
lane, candidate blocks are dealt to lanes, and the two join on the lane, by a shuffle: Spark would size
query blocks before they are repeated. A task holds one block of each at a time and keeps a query's k
best per block, so memory is bounded and no pair leaves a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import shuffle_partitions

ROWS, QUERIES = 4096, 2048
#: Bits of an id's hash by which a sample is narrowed down before it is collected.
CELL_BITS = 16
FOUND = "query_id long, vec_id long, score double"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and vector (doubles): finite vectors of the most common length, ties to the shorter.

    Null vectors and those with null or non-finite components, and rows without an id, are left out.
    """
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & vector.isNotNull() & finite & (F.size(vector) > 0))
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    sizes = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("vector") == (sizes["n"] if sizes else 0))


def query_rows(vectors: DataFrame, every: int) -> DataFrame:
    """The rows whose id is divisible by ``every``; of rows with one id, the one with the least vector."""
    return vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def to_matrix(vectors: pa.Array) -> np.ndarray:
    return np.stack(vectors.to_numpy(zero_copy_only=False)) if len(vectors) else np.zeros((0, 0))


def pack(vectors: DataFrame, rows: int, lanes: int, derive: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """Blocks (lane, ids, parts): ``derive`` turns a matrix into arrays that are kept row by row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() * 7919
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                part = batch.slice(low, rows)
                arrays = derive(to_matrix(part.column(1)))
                ids = part.column(0).to_numpy().astype("<i8").tobytes()
                columns = [[block % lanes], [ids], [[a.tobytes() for a in arrays]]]
                types = [pa.int32(), pa.binary(), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lane", "ids", "parts"]
                )
                block += 1

    return vectors.select("vec_id", "vector").mapInArrow(scan, "lane int, ids binary, parts array<binary>")


Search = Callable[[list[np.ndarray], list[np.ndarray], int], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def best(queries: DataFrame, blocks: DataFrame, lanes: int, k: int, search: Search) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best over all blocks, ties to the smaller vec_id.

    ``search`` gets the arrays of a query block and of a candidate block, ids first, and yields per
    query its place, the places of its candidates and their scores.
    """
    q = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"),
        F.col("ids").alias("query_ids"), F.col("parts").alias("query_parts"),
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q_parts, c_ids, c_parts = (batch.column(c)[i].as_py() for c in range(4))
                q_ids, c_ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(c_ids, "<i8")
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for place, found, scores in search([q_ids, *q_parts], [c_ids, *c_parts], k):
                    top = np.lexsort((c_ids[found], -scores))[:k]
                    out.append((np.full(len(top), q_ids[place]), c_ids[found][top], scores[top].astype(np.float64)))
                if out:
                    columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    # Spark's estimate leaves out the repeats, so it would broadcast what is as many times larger as there are lanes.
    met = q.hint("merge").join(blocks, "lane").select("query_ids", "query_parts", "ids", "parts")
    found = met.mapInArrow(scan, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def lanes_of(vectors: DataFrame) -> int:
    return shuffle_partitions(vectors.sparkSession)


def bounded_sample(vectors: DataFrame, rows: int) -> np.ndarray:
    """At most ``rows`` vectors, spread over all ids by hash; the same whenever the table is the same.

    Each task would send as many to the driver, so a count per hash cell tells first up to where they lie.
    """
    hashed = F.xxhash64("vec_id")
    cell = F.shiftright(hashed, 64 - CELL_BITS)
    up_to, there = None, 0
    for up_to, n in vectors.groupBy(cell.alias("cell")).count().orderBy("cell").collect():
        there += n
        if there >= rows:
            break
    near = vectors if up_to is None else vectors.where(cell <= up_to)
    picked = near.orderBy(hashed, "vec_id", "vector").limit(rows).select("vector").collect()
    return np.array([r[0] for r in picked], np.float64)

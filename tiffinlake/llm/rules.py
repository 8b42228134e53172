"""Quality classifier as a sparse rule ensemble, compiled into Spark columns.

Statistics of a text are numbers counted in one pass over its bytes. A forest of shallow trees over
them is fitted on labelled documents; every path from a root to a node is a conjunctive rule. A lasso
logistic regression over the rules, 1 where they hold, leaves few with a weight. The model is those
rules and weights, and a score is one Spark column over the statistics: the logistic function of the
weights of the rules that hold. So scoring needs no model object and no shuffle.

The fit uses at most ``SAMPLE`` labelled documents, those with the smallest hashes of their ids, in a
fixed order, so the same table gives the same model. Labels, language, source and id are not inputs.

Defined cases: a null or empty text has the statistics of no words (all 0) and gets a score like any
other; documents without a label of 0 or 1 aren't learned from, documents with several are learned
from once per label; without labels of both kinds every score is the share of 1 among them, or 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .common import stored
from .words import STRETCH, buffers, strings, word_hashes

SAMPLE = 20_000
TREES, DEPTH, LASSO, SEED = 12, 3, 0.001, 17
#: Parts that the sample is dealt to, whatever the cluster, so that the fit is the same.
PARTS = 4

#: Kinds of bytes that are counted; bytes of no kind are lower-case letters and longer characters.
BYTES = {
    "upper": bytes(range(65, 91)),
    "digits": b"0123456789",
    "blanks": b" \t\n\x0b\x0c\r",
    "pipes": b"|",
    "shouts": b"!?",
    "stops": b".,;:",
    "marks": b"#$%&*+<=>@\\^_`{}~",
    "accented": bytes(range(128, 256)),
}
STATISTICS = (
    "words", "word_length", "distinct", "repeated", *BYTES, "lines", "distinct_lines",
)


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    for i, members in enumerate(BYTES.values()):
        kinds[list(members)] = i + 1
    return kinds


KINDS = _kinds()


def statistics_of(texts: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` per text; shares are 0 where there is nothing to share."""
    data, offsets = buffers(texts)
    out = np.zeros((len(texts), len(STATISTICS)))
    low = 0
    while low < len(texts):  # some texts at a time, whole texts always
        high = low + 1
        while high < len(texts) and offsets[high + 1] - offsets[low] <= STRETCH:
            high += 1
        part, own = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        words, counts = word_hashes(part, own)
        kinds = KINDS[part]
        start = 0
        for i, n in enumerate(counts.tolist()):
            size = int(own[i + 1] - own[i])
            w = words[start : start + n]
            start += n
            shares = np.bincount(kinds[own[i] : own[i + 1]], minlength=len(BYTES) + 1)[1:] / max(size, 1)
            lines = [x for x in part[own[i] : own[i + 1]].tobytes().split(b"\n") if x]
            out[low + i] = (
                np.log1p(n), (size - shares[2] * size) / max(n, 1), len(np.unique(w)) / max(n, 1),
                np.count_nonzero(w[1:] == w[:-1]) / max(n, 1), *shares,
                len(lines) / max(n, 1), len(set(lines)) / max(len(lines), 1),
            )
        low = high
    return out


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with a double column per statistic, and their names. One pass over whole texts, no shuffle."""
    names = [f"_s_{s}" for s in STATISTICS]
    keep = docs.columns
    at = keep.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics_of(strings(batch.column(at)))
            columns = [pa.array(np.ascontiguousarray(c)) for c in found.T]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*keep, *names])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return docs.mapInArrow(scan, schema), names


class Test(NamedTuple):
    statistic: str
    above: bool
    bound: float

    def column(self) -> Column:
        return F.col(self.statistic) > self.bound if self.above else F.col(self.statistic) <= self.bound


Rule = tuple[Test, ...]


class RuleModel(NamedTuple):
    intercept: float
    weights: list[tuple[Rule, float]]

    def score(self) -> Column:
        """A number from 0 to 1 over the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: Rule) -> Column:
    column = rule[0].column()
    for test in rule[1:]:
        column = column & test.column()
    return column


def tree_rules(tree, names: Sequence[str]) -> list[Rule]:
    """The conjunction of tests on the way to every node of a fitted tree but its root."""
    found: list[Rule] = []

    def walk(node, path: Rule) -> None:
        if path:
            found.append(path)
        if node.numDescendants() == 0:
            return
        split = node.split()
        name, bound = names[split.featureIndex()], split.threshold()
        walk(node.leftChild(), (*path, Test(name, False, bound)))
        walk(node.rightChild(), (*path, Test(name, True, bound)))

    walk(tree._call_java("rootNode"), ())
    return found


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """The model of documents (doc_id, text) and labels (doc_id, quality: 0 or 1) that aren't held out.

    The sample is chosen on ids alone. It has at most ``sample`` of them, so it may be sent to all tasks
    whatever the size of the tables, and the texts are read where they lie.
    """
    known = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("double").alias("label"))
    known = known.where(~held_out()).distinct().join(docs.select("doc_id").distinct(), "doc_id")
    picked = stored(known.orderBy(F.crc32(F.col("doc_id").cast("string")), "doc_id", "label").limit(sample), "picked")
    rows, names = with_statistics(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
    # Of rows with one id the one with the least statistics counts.
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(*names)).alias("s")).select("doc_id", "label", "s.*")
    rows = stored(rows, "sample").repartition(PARTS, "doc_id").sortWithinPartitions("doc_id", "label").cache()
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = (counts.get(1.0, 0) + 0.5) / (sum(counts.values()) + 1)
        return RuleModel(math.log(share / (1 - share)), [])
    vectors = VectorAssembler(inputCols=names, outputCol="statistics").transform(rows)
    forest = RandomForestClassifier(
        featuresCol="statistics", numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, seed=SEED
    ).fit(vectors)
    rules = sorted(set(r for tree in forest.trees for r in tree_rules(tree, names)))
    if not rules:
        share = counts[1.0] / sum(counts.values())
        return RuleModel(math.log(share / (1 - share)), [])
    fired = rows.select("label", *[holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    fired = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="rules").transform(fired)
    fired = fired.select("label", "rules").cache()
    fitted = LogisticRegression(
        featuresCol="rules", regParam=lasso, elasticNetParam=1.0, maxIter=40, standardization=False
    ).fit(fired)
    weights = [(r, float(w)) for r, w in zip(rules, fitted.coefficients.toArray(), strict=True) if abs(w) > 1e-6]
    fired.unpersist()
    rows.unpersist()
    return RuleModel(float(fitted.intercept), weights)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def scored(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``docs`` with score and predicted (1 from 0.5 on)."""
    rows, names = with_statistics(docs.drop("score", "predicted"))
    rows = rows.withColumn("score", model.score()).drop(*names)
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

"""Document fingerprints by I-Match: hashes of the terms that are neither common nor rare.

Terms are runs of characters other than white space and ASCII punctuation; only A-Z are lower-cased. The
lexicon holds the terms within a band of inverse document frequency, counted over all documents: those in
at most one document of ``COMMON`` and, octave by octave, in no fewer than one of ``RARE``. Terms in one
document of x number at most x times the mean of distinct terms per document, whatever the number of
documents, so the lexicon is small; the band ends before the octave that would take it past ``LEXICON``
terms. It is the only thing sent to all tasks.

A document's terms in the lexicon are sorted and made distinct. The fingerprint is a hash of all of them and
hashes of random sub-lexicons: ``SUBSETS`` disjoint ones at each of two densities, 1 / 2^level and twice that,
of which the level follows from the number of terms, so that a subset holds about one of them whatever the
document's length. A changed term changes only the subsets it belongs to. Likeness is the share of equal hashes
among the subsets that hold a term of either document, at the sparsest density that both have and that is held
often enough; documents whose numbers of terms are far apart have none in common and a likeness of 0. A
document without a term in the lexicon is hashed whole: it is like equal texts only.

``with_next`` brings every document together with the next one: rows are dealt by ranges of the id, sorted,
and read in order, so a document meets its successor in passing and texts move once. What the last
row of a range needs of the next range's first is settled afterwards, on two rows a range.

Defined cases: a null text is empty and has its own fingerprint; a null id comes before all others;
of rows with one id the text decides, by hash, which comes first; equal rows are neighbours of each other, in
any order, and a number per row spreads them over ranges; a single row is its own next. Texts of any length
are read whole. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored, text_of
from .words import U64, buffers, mix, strings, word_hashes

COMMON, RARE, LEXICON = 8, 2048, 1 << 19
#: Sub-lexicons per density, the lowest level, and the held subsets that make a density count.
SUBSETS, LOWEST, ENOUGH = 64, 6, 8
#: A fingerprint in 16-bit numbers: its level, 4 of the whole hash, the subsets' hashes, 0 where they hold nothing.
WHOLE, SLOTS = 5, 5 + 2 * SUBSETS
U16 = np.uint16
#: Terms of a task are added up until there are so many, and texts are hashed so many bytes at a time.
HELD, BYTES = 1 << 21, 1 << 23


def _plain() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[[c for c in range(33, 128) if not chr(c).isalnum()]] = 32
    return table


PLAIN = _plain()


def terms(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the terms in order, terms per text) of stretches of the texts."""
    data, offsets = buffers(texts)
    low = 0
    while low < len(texts):
        high = low + 1
        while high < len(texts) and offsets[high + 1] - offsets[low] <= BYTES:
            high += 1
        yield word_hashes(PLAIN[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low])
        low = high


# --- lexicon


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term (a 64-bit hash), n: documents that hold it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sums = np.zeros(0, U64), np.zeros(0, np.int64)
        for batch in batches:
            for hashes, counts in terms(strings(batch.column(0))):
                ends = np.cumsum(counts)
                own = [np.unique(hashes[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                fresh, n = np.unique(np.concatenate([np.zeros(0, U64), *own]), return_counts=True)
                merged, place = np.unique(np.concatenate([found, fresh]), return_inverse=True)
                sums = np.bincount(place, np.concatenate([sums, n]), len(merged)).astype(np.int64)
                found = merged
                if len(found) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(sums)], names=["term", "n"])
                    found, sums = np.zeros(0, U64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(sums)], names=["term", "n"])

    return docs.select(text_of().alias("text")).mapInArrow(scan, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame) -> np.ndarray:
    """The sorted hashes of the terms within the band; at most ``LEXICON``."""
    documents = docs.count()
    within = (F.col("n") <= max(documents // COMMON, 1)) & (F.col("n") >= -(-documents // RARE))
    octave = F.floor(F.log2(F.lit(float(documents or 1)) / F.col("n"))).cast("int")
    band = stored(document_frequencies(docs).where(within).select("term", octave.alias("octave")), "lexicon")
    room, last = LEXICON, -1
    for row in band.groupBy("octave").count().orderBy("octave").collect():  # an octave each
        if row["count"] > room:
            break
        room, last = room - row["count"], row["octave"]
    picked = band.where(F.col("octave") <= last).select("term").toArrow()
    return np.sort(picked.column(0).to_numpy().view(U64))


# --- fingerprints


def fingerprints_of(lexicon: np.ndarray, texts: list[str]) -> np.ndarray:
    """(texts, SLOTS) 16-bit numbers for a sorted lexicon."""
    total, held = np.zeros((len(texts), 2 * SUBSETS), U64), np.zeros((len(texts), 2 * SUBSETS), bool)
    level, whole = np.zeros(len(texts), np.int64), np.zeros(len(texts), U64)
    low = 0
    for hashes, counts in terms(pa.array(texts, pa.string())):
        doc = np.repeat(np.arange(low, low + len(counts)), counts)
        low += len(counts)
        if not len(lexicon):
            continue
        place = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        known = lexicon[place] == hashes
        doc, term = np.divmod(np.unique(doc[known] * len(lexicon) + place[known]), len(lexicon))  # sorted, distinct
        sizes = np.bincount(doc, minlength=len(texts))
        level = np.where(sizes > 0, np.maximum(np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64) + 1, LOWEST + 1), level)
        term = lexicon[term]
        value = mix(term * U64(2) + U64(1))
        np.add.at(whole, doc, value)
        for i in range(2):
            own = level[doc] - i
            drawn = (mix(term + own.astype(U64)) & ((U64(1) << own.astype(U64)) - U64(1))).astype(np.int64)
            inside = np.flatnonzero(drawn < SUBSETS)
            at = doc[inside], i * SUBSETS + drawn[inside]
            np.add.at(total, at, value[inside])
            held[at] = True
    whole = mix(whole)
    for i in np.flatnonzero(level == 0).tolist():
        whole[i] = int.from_bytes(hashlib.blake2b(texts[i].encode(), digest_size=8).digest())
    slots = np.where(held, np.maximum((mix(total) >> U64(48)).astype(U16), U16(1)), U16(0))
    return np.concatenate([level.astype(U16)[:, None], whole[:, None].view(U16), slots], axis=1)


def shown(prints: np.ndarray) -> list[str]:
    """Hexadecimal texts, four digits a number."""
    digits = prints.astype(">u2").view(np.uint8).reshape(len(prints), 2 * SLOTS)
    return [bytes(row).hex() for row in digits]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per row: equal hashes among the subsets that hold a term of either, at a density of both."""
    out = (a[:, :WHOLE] == b[:, :WHOLE]).all(1).astype(np.float64)
    levels = a[:, 0].astype(np.int64), b[:, 0].astype(np.int64)
    halves = [(x[:, WHOLE : WHOLE + SUBSETS], x[:, WHOLE + SUBSETS :]) for x in (a, b)]
    todo = (levels[0] > 0) & (levels[1] > 0)
    for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)):  # the sparsest common density first
        rows = np.flatnonzero(todo & (levels[0] - i == levels[1] - j))
        x, y = halves[0][i][rows], halves[1][j][rows]
        either = (x != 0) | (y != 0)
        held = either.sum(1)
        out[rows] = ((x == y) & either).sum(1) / np.maximum(held, 1)
        todo[rows[held >= ENOUGH]] = False
    return out


def edited(text: str, following: str) -> str:
    """The text with its second half replaced by the start of another, as long as that reaches."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)
NAMES = [f.split()[0] for f in RESULT.split(", ")]


def compared(lex: np.ndarray, ids: list, texts: list[str], prints: np.ndarray) -> list[pa.Array]:
    """The result of all but the last row, each with the one after it as its next."""
    cut = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    other = fingerprints_of(lex, cut)
    return [
        pa.array(ids[:-1], pa.int64()),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in cut], pa.string()),
        pa.array(shown(prints[:-1]), pa.string()),
        pa.array(shown(other), pa.string()),
        pa.array(likeness(prints[:-1], other)),
        pa.array(likeness(prints[:-1], prints[1:])),
    ]


def groups_of(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of a batch, some ``BYTES`` of text at a time."""
    offsets = buffers(texts)[1]
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + BYTES)) - 1)
        yield low, high - low
        low = high


def with_next(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """The fingerprint of every row of doc_id, text and its likeness to the next row's and to the edited text's."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(hashes)
    edge_names = [*NAMES, "task", "last", "text"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, task = sent.value, TaskContext.get().partitionId()
        ids, texts, prints = [], [], np.zeros((0, SLOTS), U16)

        def edge(last: bool) -> pa.RecordBatch:
            row = dict.fromkeys(NAMES) | {"doc_id": ids[-1 if last else 0], "task": task, "last": last, "text": texts[-1 if last else 0]}
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema(
            [(n, pa.int64() if n in ("doc_id", "n_chars") else pa.float64() if n.startswith("near") else pa.string()) for n in NAMES]
            + [("task", pa.int64()), ("last", pa.bool_()), ("text", pa.string())]
        )
        seen = False
        for batch in batches:
            column = strings(batch.column(1))
            for low, size in groups_of(column):
                fresh = column.slice(low, size).to_pylist()
                ids += batch.column(0).slice(low, size).to_pylist()
                texts += fresh
                prints = np.concatenate([prints, fingerprints_of(lex, fresh)])
                if not seen:
                    yield edge(last=False)
                    seen = True
                found = compared(lex, ids, texts, prints)
                none = [pa.nulls(len(ids) - 1, f.type) for f in list(schema)[-3:]]
                yield pa.RecordBatch.from_arrays([*found, *none], names=edge_names)
                ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]
        if seen:
            yield edge(last=True)

    ordered = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.monotonically_increasing_id().alias("row")
    )
    ordered = ordered.withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    found = stored(ordered.select("doc_id", "text").mapInArrow(scan, RESULT + ", task long, last boolean, text string"), "prints")
    tasks = sorted(r[0] for r in found.where("last").select("task").collect())  # a number per range
    if not tasks:
        return found.select(*NAMES)
    after = spark.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1], strict=True)), "task long, after long")
    ends = found.where("last").select("doc_id", "text", "task").join(after, "task")
    starts = found.where("not last").select(F.col("task").alias("after"), F.col("text").alias("following"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = sent.value
        for batch in batches:
            for doc_id, *pair in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = compared(lex, [doc_id, None], pair, fingerprints_of(lex, pair))
                yield pa.RecordBatch.from_arrays(row, names=NAMES)

    settled = ends.join(starts, "after").select("doc_id", "text", "following").mapInArrow(settle, RESULT)
    return found.where("last is null").select(*NAMES).unionByName(settled)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of all rows."""
    docs = docs.select("doc_id", "text")
    return with_next(docs, lexicon(docs))

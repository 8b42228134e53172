"""Packing by best-fit decreasing: token sequences of fixed windows with little padding.

Documents become token ids and an end id. Overlong ones are first cut into full windows, each a
sequence of its own; what remains of a document is one piece shorter than a window. Pieces are dealt
by hash into groups of about ``GROUP`` and each group is packed longest first: a segment tree indexed
by remaining capacity finds the open window that a piece leaves the least room in, or opens a new one.
A group this large already fills its windows almost completely, so groups need not know each other.

Defined cases: a null or empty text is the end id alone; rows are pieces of their own whatever their
doc_id, so repeated rows and null ids stay apart; an empty table gives no piece. Very long texts are
tokenized in stretches that end before a single blank between two words, where byte-level pieces end
anyway, so the ids are those of the whole text.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored

WINDOW, END_ID, GROUP = 2048, 1, 16384
#: Rows whose pieces leave a task at once.
ROWS = 512
#: Characters of a long text that are tokenized at once.
STRETCH = 1 << 17
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A run this long goes to the slower library, which takes n log n steps for it.
_RUN = re.compile(r"\S{2000}|\s{2000}")
_LOADED: dict = {}


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The bytes of each id, if the file is plain byte-level BPE whose ids are in the order of its merges."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told["model"], told["pre_tokenizer"]
    if told["normalizer"] or not before or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable}  # the other bytes are shown as characters from 256 on
    shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    added = {t["content"] for t in told["added_tokens"]}
    ranks = {bytes(shown[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    in_order = all(model["vocab"].get(t) == 256 + i for i, t in enumerate(merged))
    return ranks if in_order and len(ranks) == 256 + len(merged) else None


def encoder(path: str):
    """A function from texts to lists of ids; loaded once per worker, one thread, as tasks share the machine.

    The ids are those of the ``tokenizers`` library for this file, control strings as ordinary text.
    Where the file allows it, ``tiktoken`` merges its vocabulary, to the same ids in a fifth of the time.
    """
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        slow.encode_special_tokens = True
        ranks = byte_ranks(path)
        fast = ranks and tiktoken.Encoding(
            "file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

        def encode(text: str) -> list[int]:
            if fast and not (len(text) >= 2000 and _RUN.search(text)):
                return fast.encode_ordinary(text)
            return slow.encode(text, add_special_tokens=False).ids

        _LOADED[path] = encode
    return _LOADED[path]


def stretches(text: str) -> list[str]:
    """The text in order, cut before single blanks between words about every ``STRETCH`` characters."""
    out, start = [], 0
    while len(text) - start > STRETCH and (m := _CUT.search(text, start + STRETCH)):
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def token_ids(path: str, text: str | None) -> np.ndarray:
    """The ids of the text and the end id, unsigned 32 bits."""
    encode = encoder(path)
    parts = [np.array(encode(part), "<u4") for part in stretches(text or "")]
    return np.concatenate([*parts, np.array([END_ID], "<u4")])


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, row long"


def cut(docs: DataFrame, path: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Pieces of rows of doc_id, text, numbered per task.

    ``keep_ids`` adds the ids, unsigned 32 bits, and ``copy``, a number of the row the piece is from.
    """
    names = [f.split()[0] for f in PIECE.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, copy = TaskContext.get().partitionId(), 0, 0
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            rows, ids_out, copies = [], [], []
            doc_ids = batch.column(0).to_pylist()
            for doc_id, text in zip(doc_ids, batch.column(1).to_pylist(), strict=True):
                ids = token_ids(path, text)
                for start in range(0, len(ids), window):
                    part = ids[start : start + window].tobytes()
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), len(ids), task, row))
                    row += 1
                    if keep_ids:
                        ids_out.append(part)
                        copies.append((task << 33) + copy)
                copy += 1
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            if keep_ids:
                columns += [pa.array(ids_out, pa.binary()), pa.array(copies, pa.int64())]
            if rows:
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids", "copy"] if keep_ids else names)

    return docs.select("doc_id", "text").mapInArrow(scan, PIECE + (", ids binary, copy long" if keep_ids else ""))


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Per piece, in the given order: its sequence, counted from 0, and its offset there.

    Leaf c of the tree counts the open windows with c places left, a node counts those below it.
    """
    leaves = 1 << window.bit_length()
    count = [0] * (2 * leaves)
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    used: list[int] = []
    sequences, offsets = [], []

    def change(capacity: int, by: int) -> None:
        node = capacity + leaves
        while node:
            count[node] += by
            node >>= 1

    for length in lengths:
        node = length + leaves
        if not count[node]:  # climb until a right neighbour has a window, then go down its left edge
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node > 1:
                node += 1
                while node < leaves:
                    node = 2 * node if count[2 * node] else 2 * node + 1
        if node > 1:
            capacity = node - leaves
            sequence = open_at[capacity].pop()
            change(capacity, -1)
        else:
            capacity, sequence = window, len(used)
            used.append(0)
        sequences.append(sequence)
        offsets.append(used[sequence])
        used[sequence] += length
        if left := capacity - length:
            open_at[left].append(sequence)
            change(left, 1)
    return sequences, offsets


def pack(docs: DataFrame, path: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its sequence_id and offset.

    Each text is tokenized once; pieces are kept in the shared folder, as their number decides how many
    groups there are. Groups hold lengths and numbers of pieces, no ids: these join by the piece's number
    afterwards, as a stream past the small table of places. Odd sequence ids are full windows, even ones
    are groups' windows.
    """
    pieces = stored(cut(docs, path, window, keep_ids), "pieces")
    rest = pieces.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // GROUP))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "task", "row"], ascending=[False, True, True])
        sequences, offsets = best_fit(group["length"].tolist(), window)
        group["sequence_id"] = (group["group"].to_numpy() * 2**32 + np.array(sequences, "i8")) * 2
        group["offset"] = np.array(offsets, "i8")
        return group.drop(columns="group")

    dealt = rest.drop("ids").withColumn("group", F.pmod(F.xxhash64("task", "row"), F.lit(groups)))
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "ids"]
    packed = dealt.groupBy("group").applyInPandas(fill, ", ".join([*columns, "sequence_id long", "offset long"]))
    if keep_ids:
        packed = packed.hint("shuffle_hash").join(rest.select("task", "row", "ids"), ["task", "row"])
        packed = packed.select(*pieces.columns, "sequence_id", "offset")
    full = pieces.where(F.col("length") == window).select(
        "*", ((F.col("task") * F.lit(2**33) + F.col("row")) * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(full).drop("task", "row")

"""Phrase collocation mining: frequent phrases of 2 to ``LONGEST`` words, scored by their weakest cut.

Every word of a text is the start of a suffix, of which ``LONGEST`` words count at most, as a phrase ends where
its piece ends. Where the texts lie, equal suffixes are counted once with their number, a stretch of text at a
time. They are routed by their two leading words, so all phrases that begin with a pair of words meet in one
task; pairs with more than a task's share of all suffixes are routed by three words, and such triples by all
of them. What is dealt out so is known from a first pass, which counts words and, in cells by hash, pairs and
triples of all texts; it decides only where suffixes go. It also shows which words are frequent: a suffix ends
before the first word that isn't, as no phrase with it can be. What tasks get of that is a bitmap of fixed size
by hash, which lets some other words through, more with more words, and never holds a frequent one back.

A task sorts pointers to its suffixes by multikey three-way quicksort: the suffixes whose word at the current
depth is less than, equal to or greater than a pivot's are three partitions, and the equal one goes on with the
next word. The size of an equal partition is the count of its phrase; partitions below ``AT_LEAST`` are
abandoned, but where a phrase's suffixes went to several tasks their counts are added up first. At ``LONGEST``
words nothing is left to compare.

Parts of a frequent phrase are frequent, so scores come from joins of the frequent phrases with themselves,
cut by cut; the longest phrase around each candidate comes from a map-side maximum over sub-phrases, and the
best of a language from a ranking in two steps, of which the first is spread over tasks.

Words are runs of characters other than blank and tab between the characters that end a piece; only A-Z are
lower-cased. In a task words are told apart by 64-bit hashes, in results by their characters. Defined cases: a null
text is empty, a null language is ``und``; repeated rows count again; texts of any length are read whole, a
text longer than a stretch being cut at an end of a piece; an empty table gives no rows; equal scores and
counts go by the phrase's UTF-8 bytes. Only lang and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import shuffle_partitions, stored, text_of
from .words import U64, buffers, hash_words, mix, strings

LONGEST, AT_LEAST, COVERED, BEST = 4, 30, 80, 2000
SCORE = 2_000_000
#: Bytes of rows sorted by language, of text counted and of text hashed at once.
ROWS_OF, STRETCH, HASHED = 6 << 20, 3 << 20, 1 << 18
#: Bytes of text a task of the sort should get, and tasks a ranking is spread over.
SHARE, SPREAD = 6 << 20, 32
#: Cells for pairs and triples: so many per task of the sort, within bounds.
CELLS_A_TASK, FEWEST_CELLS, MOST_CELLS = 64, 1 << 16, 1 << 20
#: Word counts that a task holds until it adds them up.
HELD = 400_000
#: Bits of the bitmap of frequent words.
FILTER_BITS = 1 << 24


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per byte: as a word holds it, 32 for all that separates words; whether it ends a piece."""
    plain = np.arange(256, dtype=np.uint8)
    plain[65:91] += 32
    ends = np.zeros(256, bool)
    ends[[*b".,;:!?", *range(10, 14)]] = True
    plain[ends] = 32
    plain[9] = 32
    return plain, ends


PLAIN, ENDS = _tables()


# --- suffixes of a stretch


def seed_of(lang: str) -> np.uint64:
    return U64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest()))


def word_cells(hashes: np.ndarray, lang: str) -> np.ndarray:
    return (mix(hashes + seed_of(lang)) % U64(FILTER_BITS)).astype(np.int64)


class Stretch:
    """The words of some texts: ``ids`` into the distinct ``words``, their ``hashes``, and the piece each word is in."""

    def __init__(self, data: np.ndarray, first: np.ndarray):
        self.plain, first = PLAIN[data], first[: len(data)]
        found, low = [(np.zeros(0, U64), np.zeros(0, np.int64))], 0
        while low < len(data):  # hashing takes many bytes for each of the text
            high = min(low + HASHED, len(data))
            while high < len(data) and not (first[high] or self.plain[high] == 32):
                high += 1
            hashes, at = hash_words(self.plain[low:high], first[low:high])
            found.append((hashes, at + low))
            low = high
        hashes, self.at = (np.concatenate(x) for x in zip(*found, strict=True))
        self.hashes, where, ids = np.unique(hashes, return_index=True, return_inverse=True)
        # Numbered in the order of the words, so that lists of them and of numbers compress well.
        self.words = self.spelled(where)
        order = pc.sort_indices(self.words).to_numpy()
        self.words, self.hashes = self.words.take(pa.array(order)), self.hashes[order]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.ids = rank[ids]
        self.piece = np.searchsorted(np.flatnonzero(ENDS[data] | first), self.at, "right")

    def spelled(self, where: np.ndarray) -> pa.Array:
        """The words at some of all places."""
        starts = self.at[where]
        inside = np.append(self.plain != 32, False)
        # A word ends at the next separator or where the next word begins, as texts may touch.
        gaps = np.flatnonzero(~inside)
        ends = gaps[np.searchsorted(gaps, starts)]
        following = np.append(self.at, len(self.plain))[where + 1]
        ends = np.minimum(ends, following)
        sizes = ends - starts
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        bytes_at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
        return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(self.plain[bytes_at].tobytes()))

    def together(self, words: int) -> np.ndarray:
        """Whether ``words`` words from each on are in one piece."""
        out = np.zeros(len(self.ids), bool)
        if len(self.ids) >= words:
            out[: len(self.ids) - words + 1] = self.piece[: len(self.ids) - words + 1] == self.piece[words - 1 :]
        return out

    def keep(self, bitmap: np.ndarray, lang: str) -> None:
        """Ends pieces before and after every word that the bitmap doesn't hold."""
        cells = word_cells(self.hashes, lang)
        rare = (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8) & 1 == 0)[self.ids]
        ends = rare.copy()
        ends[1:] |= rare[:-1]
        self.piece = self.piece + np.cumsum(ends)

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct suffixes of two words or more, (n, LONGEST) ids with -1 past their end, and their counts."""
        pairs = np.flatnonzero(self.together(2))
        size = np.full(len(self.ids), 1, np.int8)
        for words in range(2, LONGEST + 1):
            size[self.together(words)] = words
        padded = np.concatenate([self.ids, np.zeros(LONGEST, np.int32)])
        rows = np.full((len(pairs), LONGEST), -1, np.int32)
        for j in range(LONGEST):
            rows[:, j] = np.where(size[pairs] > j, padded[pairs + j], -1)
        if not len(rows):
            return rows, np.zeros(0, np.int64)
        base = len(self.hashes) + 1
        code = rows[:, 0].astype(np.int64) + 1
        for j in range(1, LONGEST):  # a number per distinct prefix, so codes stay below rows times words
            code = np.unique(code * base + rows[:, j] + 1, return_inverse=True)[1]
        _, which, counts = np.unique(code, return_index=True, return_counts=True)
        return rows[which], counts

    def routes(self, lang: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of each suffix' two, three and all words; the same in every task."""
        seed = seed_of(lang)
        of = np.append(self.hashes, U64(0))
        two = mix(mix(of[rows[:, 0]] + seed) + of[rows[:, 1]])
        three = mix(two + of[rows[:, 2]] * U64(3))
        return two, three, mix(three + of[rows[:, 3]] * U64(5))


def stretches(batch: pa.RecordBatch) -> Iterator[tuple[str, Stretch]]:
    """(language, words) of a batch (lang, text): some ``ROWS_OF`` bytes of rows at a time, those of one language
    together, and of these ``STRETCH`` bytes of text at once."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64))
    row = 0
    while row < batch.num_rows:
        before = sizes[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(sizes, before + ROWS_OF, "right")))
        part = batch.slice(row, end - row)
        row = end
        for lang in pc.unique(part.column(0)).to_pylist():
            data, offsets = buffers(strings(part.column(1).filter(pc.equal(part.column(0), lang))))
            first = np.zeros(len(data) + 1, bool)
            first[offsets] = True
            low = 0
            while low < len(data):
                high = min(low + STRETCH, len(data))
                while high < len(data) and not (first[high] or ENDS[data[high - 1]]):
                    high += 1
                yield lang, Stretch(data[low:high], first[low : high + 1])
                low = high


# --- first pass: words, and cells of pairs and triples


def counted(docs: DataFrame, cells: int) -> DataFrame:
    """lang, word, n of all words; lang and word null: cell, n of pairs (from 0) and triples (from ``cells``)."""

    def added_up(parts: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(parts).group_by(["lang", "word"]).aggregate([("n", "sum")])
        return whole.select(["lang", "word", "n_sum"]).rename_columns(["lang", "word", "n"])

    def shown(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for part in table.combine_chunks().to_batches(max_chunksize=50_000):
            columns = [part.column(0), part.column(1), pa.nulls(part.num_rows, pa.int64()), part.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "cell", "n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = np.zeros(2 * cells, np.int64)
        parts: list[pa.Table] = []
        for batch in batches:
            for lang, stretch in stretches(batch):
                if not len(stretch.ids):
                    continue
                n = np.bincount(stretch.ids)
                parts.append(pa.table([pa.array([lang] * len(n)), stretch.words, pa.array(n)], names=["lang", "word", "n"]))
                if sum(p.num_rows for p in parts) > HELD:
                    parts = [added_up(parts)]
                    if parts[0].num_rows > HELD // 2:
                        yield from shown(parts.pop())
                rows, counts = stretch.suffixes()
                two, three, _ = stretch.routes(lang, rows)
                for i, route in enumerate((two, three)):
                    loads += np.bincount((route % U64(cells)).astype(np.int64) + i * cells, counts, 2 * cells).astype(np.int64)
        if parts:
            yield from shown(added_up(parts))
        held = np.flatnonzero(loads)
        none = pa.nulls(len(held), pa.string())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(held), pa.array(loads[held])], names=["lang", "word", "cell", "n"])

    found = docs.mapInArrow(scan, "lang string, word string, cell long, n long")
    return found.groupBy("lang", "word", "cell").agg(F.sum("n").alias("n"))


# --- second pass: suffixes to tasks, sorted there


def packed(data: bytes) -> bytes:
    """Compressed, after four bytes that tell the size."""
    return len(data).to_bytes(4, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[4:], int.from_bytes(data[:4], "little"), "zstd", asbytes=True)


def bitmap_of(words: DataFrame) -> np.ndarray:
    """``FILTER_BITS`` bits, those of all (lang, word) set; at most an eighth as many rows reach the driver."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                data, offsets = buffers(strings(batch.column(1).filter(pc.equal(batch.column(0), lang))))
                first = np.zeros(len(data) + 1, bool)
                first[offsets] = True
                cells = word_cells(hash_words(data, first[: len(data)])[0], lang)
                yield pa.RecordBatch.from_arrays([pa.array(cells >> 3), pa.array(1 << (cells & 7))], names=["at", "bit"])

    found = words.select("lang", "word").mapInArrow(scan, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    bitmap[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.uint8)
    return bitmap


def routed(docs: DataFrame, tasks: int, cells: int, hot: np.ndarray, bitmap: np.ndarray) -> DataFrame:
    """Suffixes by task: lang, whole (words whose count is complete there), words, rows (column by column), counts,
    compressed."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["task", "lang", "whole", "words", "rows", "counts"]
        for batch in batches:
            for lang, stretch in stretches(batch):
                stretch.keep(sent.value, lang)
                rows, counts = stretch.suffixes()
                if not len(rows):
                    continue
                two, three, four = stretch.routes(lang, rows)
                hot_two = np.isin((two % U64(cells)).astype(np.int64), hot)
                hot_three = np.isin((three % U64(cells)).astype(np.int64) + cells, hot)
                whole = 2 + hot_two.astype(np.int64) + (hot_two & hot_three)
                task = (mix(np.choose(whole - 2, [two, three, four])) % U64(tasks)).astype(np.int64)
                order = np.lexsort((whole, task))  # keeps suffixes sorted within a run
                rows, counts, task, whole = rows[order], counts[order], task[order], whole[order]
                lows, highs = bounds_of(task * 3 + whole)
                spelled, blobs, numbers = [], [], []
                for low, high in zip(lows.tolist(), highs.tolist(), strict=True):
                    ids, local = np.unique(rows[low:high], return_inverse=True)
                    none = int(ids[0] == -1)
                    spelled.append(packed("\n".join(stretch.words.take(pa.array(ids[none:])).to_pylist()).encode()))
                    kind = "<i4" if len(ids) > 32_000 else "<i2"
                    blobs.append(packed((local.reshape(-1, LONGEST) - none).T.astype(kind).tobytes()))
                    numbers.append(packed(counts[low:high].astype("<i4").tobytes()))
                columns = [
                    pa.array(task[lows]), pa.array([lang] * len(lows)), pa.array(whole[lows]),
                    *(pa.array(c, pa.binary()) for c in (spelled, blobs, numbers)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(scan, "task long, lang string, whole long, words binary, rows binary, counts binary")


def bounds_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins and ends."""
    starts = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(sorted_keys))


def quicksort(rows: np.ndarray, counts: np.ndarray, whole: int) -> Iterator[tuple[tuple, int]]:
    """(word ids, count) of the phrases of two words or more among suffixes: all of fewer than ``whole`` words,
    of longer ones those counted ``AT_LEAST`` times."""
    nodes = [(np.arange(len(rows)), 0, ())]
    while nodes:
        pointers, depth, phrase = nodes.pop()
        needed = 1 if 2 < whole > depth + 1 else AT_LEAST
        words = rows[pointers, depth]
        pivot = words[len(words) // 2]
        less, equal = words < pivot, words == pivot
        for part in (pointers[less], pointers[~(less | equal)]):
            if len(part) and counts[part].sum() >= needed:
                nodes.append((part, depth, phrase))
        if pivot < 0:
            continue
        same = pointers[equal]
        size = int(counts[same].sum(dtype=np.int64))
        if size < needed:
            continue
        found = (*phrase, int(pivot))
        if depth:
            yield found, size
        if depth + 1 < LONGEST:
            nodes.append((same, depth + 1, found))


def sort_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, size, phrase, n from all suffixes of a task."""
    parts: dict[tuple[str, int], list] = {}
    for batch in batches:
        for _, lang, whole, words, rows, counts in zip(*batch.columns, strict=True):
            words = pa.array(unpacked(words.as_py()).decode().split("\n"))
            rows, counts = unpacked(rows.as_py()), np.frombuffer(unpacked(counts.as_py()), "<i4")
            kind = "<i4" if len(rows) == 4 * LONGEST * len(counts) else "<i2"
            own = parts.setdefault((lang.as_py(), whole.as_py()), [[], [], [], 0])
            ids = np.frombuffer(rows, kind).astype(np.int32).reshape(LONGEST, -1).T
            own[0].append(words)
            own[1].append(np.where(ids >= 0, ids + own[3], -1).astype(np.int32))
            own[2].append(counts)
            own[3] += len(words)
    while parts:
        (lang, whole), (words, rows, counts, _) = parts.popitem()
        named = pa.concat_arrays(words).dictionary_encode()
        of = np.append(named.indices.to_numpy(), -1).astype(np.int32)
        rows = np.concatenate([of[rows.pop(0)] for _ in range(len(rows))])
        counts = np.concatenate(counts)
        # Most partitions by the two leading words that are too small as a whole are abandoned before the sort.
        if whole == 2:
            cells = (mix(rows[:, 0].astype(U64) << U64(32) | rows[:, 1].astype(U64)) >> U64(44)).astype(np.int32)
            keep = np.bincount(cells, counts, 1 << 20)[cells] >= AT_LEAST
            rows, counts = rows[keep], counts[keep]
        if not len(rows):
            continue
        text = named.dictionary.to_pylist()
        found = [(" ".join(text[i] for i in ids), len(ids), n) for ids, n in quicksort(rows, counts, whole)]
        if found:
            phrases, sizes, n = zip(*found, strict=True)
            columns = [pa.array([lang] * len(n)), pa.array(sizes, pa.int64()), pa.array(phrases), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "size", "phrase", "n"])


def frequent(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, n of all phrases that are frequent, words included; lang, n of all words)."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    amount = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    tasks = max(shuffle_partitions(docs.sparkSession), -(-amount // SHARE))
    cells = min(max(FEWEST_CELLS, 1 << (CELLS_A_TASK * tasks - 1).bit_length()), MOST_CELLS)
    first = stored(counted(docs, cells), "words")
    words = first.where("word is not null")
    loads = first.where("word is null")
    total = loads.where(F.col("cell") < cells).agg(F.sum("n")).first()[0] or 0
    # Cells of more than an eighth of a task's share are 8 a task at most, of pairs and of triples.
    hot = loads.where(F.col("n") > max(total // (8 * tasks), 1)).select("cell").toArrow().column(0).to_numpy()
    bitmap = bitmap_of(words.where(F.col("n") >= AT_LEAST))
    sorted_out = routed(docs, tasks, cells, hot, bitmap).repartition(tasks, "task").mapInArrow(
        sort_task, "lang string, size long, phrase string, n long"
    )
    longer = sorted_out.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    single = words.select("lang", F.lit(1).cast("long").alias("size"), F.col("word").alias("phrase"), "n")
    both = longer.unionByName(single).where(F.col("n") >= AT_LEAST)
    return stored(both, "frequent"), words.groupBy("lang").agg(F.sum("n").alias("n"))


# --- scores


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, score: every candidate with its lowest-scoring cut."""
    cut = F.explode(F.sequence(F.lit(1), (F.col("size") - 1).cast("int"))).alias("k")
    cuts = found.where("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"), cut)
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("right", F.expr("substring_index(phrase, ' ', cast(k - size as int))"))
    parts = found.where(F.col("size") < LONGEST)
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    both = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    wide = "cast({} as decimal(20, 0))"
    score = F.expr(f"({SCORE} * {wide.format('a')}) div ({wide.format('l')} + {wide.format('r')})")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "phrase", "size", "a").agg(least).select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def covered(found: DataFrame) -> DataFrame:
    """lang, phrase, longer: the largest count of a longer phrase around each phrase of two words or more."""
    words = F.split("phrase", " ")
    spots = F.expr(
        "flatten(transform(sequence(2, cast(size - 1 as int)), n -> transform(sequence(1, cast(size - n + 1 as int)), i -> struct(i, n))))"
    )
    inner = found.where("size >= 3").select("lang", "n", words.alias("words"), F.explode(spots).alias("spot"))
    phrase = F.expr("array_join(slice(words, spot.i, spot.n), ' ')").alias("phrase")
    return inner.groupBy("lang", phrase).agg(F.max("n").alias("longer"))


def mine(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``BEST`` phrases of rows of lang, text."""
    found, words = frequent(docs)
    both = scored(found).join(covered(found), ["lang", "phrase"], "left")
    wide = "cast({} as decimal(20, 0))"
    inside = F.expr(f"100 * {wide.format('longer')} >= {COVERED} * {wide.format('a')}")
    kept = both.where(~F.coalesce(inside, F.lit(False)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # The best of a part of a language's phrases hold all that are among its best.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= BEST)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= BEST)
    return kept.join(words, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")

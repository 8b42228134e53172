"""N-gram Jaccard join: which documents share at least ``percent`` % of their distinct word n-grams.

Equal n-gram sets are one node, so copies cost nothing. Nodes that can be linked must share one of
their first n-grams in any fixed order (a few per cent of each set, by its size); rare n-grams come
first, by a count of all documents' n-grams, so common passages hardly ever count. Nodes with a common
first n-gram form a tile, in order of size. Within a tile only nodes of one size band (sizes within
``percent`` %) are compared, by signatures: bitmaps of 128 bits with a bit for whether an odd number of
n-grams hashes there. Bits that differ bound the n-grams that differ from below, hence the overlap from
above. Pairs that the bound allows are tested again with signatures of 2 to 4 bits per n-gram, and what
these allow is checked on the exact sorted arrays.

Large groups of near copies would give every pair. So a tile of more than ``SMALL`` nodes first gives
each node's closest earlier partner alone and sets its nodes aside. Once those pairs are checked and
joined to components, tiles set aside are looked at again: pairs inside a component can't add
anything, all other pairs that the bound allows are checked. No link between components is lost, and
the components are those of all links. An n-gram of very many nodes is dealt over several tiles first
and by size bands the second time.

N-grams are compared by 64-bit hashes and sets by 128-bit digests of them; tiles know sets by the first
64 bits of these, their keys. Words are runs of characters other than blanks and line breaks; only A-Z are lower-cased.

Defined cases: null or empty texts and texts of blanks have the empty set and are linked with nothing;
a text of fewer words than n has one n-gram, all of it; equal documents are linked; repeated ids are
rows of their own with one id. Texts of any length are read whole, in stretches of ``STRETCH`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import scratch, stored
from .words import BASE, STRETCH, U64, buffers, mix, strings, word_hashes

#: The count of all n-grams has this many cells; it is the only thing sent to all tasks.
CELLS, SLICES = 1 << 20, 64
#: Tiles up to SMALL nodes give all their pairs at once; n-grams beyond TILE nodes are dealt over several.
SMALL, TILE = 4, 4096
SEEN = 200_000
#: Bits of a signature that rows of a tile carry at most, and of the filter of wanted documents.
TILE_BITS, FILTER_BITS = 1024, 1 << 23


# --- texts to sorted arrays of hashes


def gram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Per text: the sorted distinct hashes of its word n-grams."""
    data, offsets = buffers(texts)
    factors = mix(np.arange(1, n + 1, dtype=U64) * BASE) | U64(1)
    low = 0
    while low < len(texts):
        high = low + 1
        while high < len(texts) and offsets[high + 1] - offsets[low] <= STRETCH:
            high += 1
        own = offsets[low : high + 1] - offsets[low]
        words, counts = word_hashes(data[offsets[low] : offsets[high]], own)
        grams = np.zeros(max(len(words) - n + 1, 0), U64)
        for j in range(n):
            grams += words[j : j + len(grams)] * factors[j]
        grams = mix(grams)
        start = 0
        for count in counts.tolist():
            if count >= n:
                g = np.sort(grams[start : start + count - n + 1])
                yield g[np.append(True, g[1:] != g[:-1])] if len(g) > 1 else g
            elif count:
                yield mix((words[start : start + count] * factors[:count]).sum(keepdims=True) + U64(count))
            else:
                yield np.zeros(0, U64)
            start += count
        low = high


def digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def key_of(nodes: pa.Array) -> pa.Array:
    """The first 64 bits of digests: what tiles know nodes by."""
    return pa.array(np.ascontiguousarray(byte_rows(nodes, 16)[:, :8]).view(np.int64).reshape(-1))


# --- nodes and the count of n-grams


def nodes_and_counts(docs: DataFrame, n: int) -> DataFrame:
    """Per document: doc_id, n_shingles, node (null for the empty set), wide signature; per task: slices of its count."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "node", "wide", "slice", "counts"]
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            sizes, nodes, wide, pending, grams_pending = [], [], [], [], 0
            for grams in gram_sets(strings(batch.column(1)), n):
                sizes.append(len(grams))
                nodes.append(digest(grams) if len(grams) else None)
                wide.append(parity(grams, max(128, 1 << (2 * len(grams)).bit_length())))
                pending.append(grams)
                grams_pending += len(grams)
                if grams_pending > CELLS:
                    total += np.bincount((np.concatenate(pending) >> U64(44)).astype(np.int64), minlength=CELLS)
                    pending, grams_pending = [], 0
            if pending:
                total += np.bincount((np.concatenate(pending) >> U64(44)).astype(np.int64), minlength=CELLS)
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
                 pa.array(wide, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())],
                names=names,
            )
        if total.any():
            parts = [narrowest(p).tobytes() for p in np.split(total, SLICES)]
            none = pa.nulls(SLICES)
            yield pa.RecordBatch.from_arrays(
                [none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.binary()),
                 pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())],
                names=names,
            )

    ddl = "doc_id long, n_shingles long, node binary, wide binary, slice int, counts binary"
    return docs.select("doc_id", "text").mapInArrow(scan, ddl)


def narrowest(counts: np.ndarray) -> np.ndarray:
    return counts.astype(next(f"<u{n}" for n in (1, 2, 4, 8) if int(counts.max()) < 1 << 8 * n))


def gram_classes(counted: DataFrame) -> np.ndarray:
    """Per cell: 0 for n-grams no more frequent than chance fills a cell, else 1 + log2 of the excess.

    The counts of all tasks are added slice by slice on the executors; what comes here has a fixed size.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(counts.as_py(), f"<u{len(counts.as_py()) * SLICES // CELLS}").astype("<i8")
                total[i] = total[i] + own if i in total else own
        sums = pa.array([c.tobytes() for c in total.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), sums], names=["slice", "counts"])

    rows = counted.where("slice is not null").select("slice", "counts").repartition("slice")
    summed = {r[0]: r[1] for r in rows.mapInArrow(add, "slice int, counts binary").collect()}
    if not summed:
        return np.zeros(CELLS, np.uint8)
    cells = np.concatenate([np.frombuffer(summed[i], "<i8") for i in range(SLICES)])
    mean = cells.mean()
    excess = cells - mean
    common = excess > 6 * np.sqrt(mean) + 8
    return np.where(common, 1 + np.log2(np.maximum(excess, 1)), 0).astype(np.uint8)


# --- postings


def prefix_sizes(size: int, percent: int) -> tuple[int, int]:
    """How many first n-grams a set shows to partners of its size or less, and to larger ones.

    So many that a linked pair has ``common_least`` of the smaller set's size in common among them.
    """
    more = common_least(size)
    as_larger = size - -(-percent * size // 100) + more
    as_smaller = size - -(-2 * percent * size // (100 + percent)) + more
    return min(as_larger, size), min(as_smaller, size)


def common_least(size):
    """First n-grams that a pair must share; long sets share some by chance, their like share many."""
    return 1 + size // 400


def parity(grams: np.ndarray, bits: int = 128) -> bytes:
    """Whether an odd number of n-grams hashes to each bit; ``bits`` is a power of 2."""
    counts = np.bincount((grams & U64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """A lower bound of the n-grams in one set only; the longer signature is folded to the other's length."""
    a, b = (np.frombuffer(z, U64) for z in (x, y))
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def fold(x: bytes, bits: int) -> bytes:
    a = np.frombuffer(x, U64)
    while 64 * len(a) > bits:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a.tobytes()


def within(x: bytes, y: bytes, m: int, n: int, percent: int) -> bool:
    """Whether sets of m and n n-grams with these signatures may be similar enough."""
    return differing(x, y) <= m + n - 2 * -(-percent * (m + n) // (100 + percent))


def byte_rows(column: pa.Array, width: int) -> np.ndarray:
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[start : start + len(column) * width].reshape(-1, width)


#: tile, the n-gram where that isn't the tile (it is dealt over several), the set's size (negative unless it
#: stands among the n-grams shown to larger sets), the node's key and its signature's halves. Postings are what
#: moves most, and columns of changing bytes are what they cost: n-gram and flags are told by the others.
POSTING = "tile long, gram long, size int, node long, sig_a long, sig_b long"
POSTING_NAMES = [f.split()[0] for f in POSTING.split(", ")]


def postings(docs: DataFrame, n: int, percent: int, classes) -> DataFrame:
    """The first n-grams of every node. Copies met in one task give them once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_cell, seen = classes.value, set()
        for batch in batches:
            parts, held = [], 0
            for grams in gram_sets(strings(batch.column(0)), n):
                if not len(grams) or (node := digest(grams)) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(node)
                as_larger, as_smaller = prefix_sizes(len(grams), percent)
                cls = of_cell[(grams >> U64(44)).astype(np.int64)]
                if cls.any():
                    order = np.lexsort((grams, cls))[:as_larger]
                    chosen, cls = grams[order], cls[order]
                else:
                    chosen, cls = grams[:as_larger], cls[:as_larger]
                tile = chosen
                dealt = (U64(1) << cls.astype(U64)) > U64(2 * TILE)  # about 2 ** (cls - 1) sets or more
                if dealt.any():
                    own = np.frombuffer(node, U64)[0]  # the node's key
                    chunks = np.maximum((U64(1) << cls.astype(U64)) // U64(TILE), U64(1))
                    tile = np.where(dealt, mix(chosen + BASE * (U64(1) + mix(chosen ^ own) % chunks)), chosen)
                both = np.frombuffer(node[:8] + parity(grams), np.int64)
                parts.append((tile, chosen, len(grams), as_smaller, dealt, both))
                held += len(chosen)
                if held >= 50_000:
                    yield posted(parts)
                    parts, held = [], 0
            if parts:
                yield posted(parts)

    def posted(parts: list) -> pa.RecordBatch:
        counts = np.array([len(p[0]) for p in parts])
        rank = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        both = np.repeat(np.stack([p[5] for p in parts]), counts, axis=0)
        size = np.repeat(np.array([p[2] for p in parts], np.int32), counts)
        shown = rank < np.repeat([p[3] for p in parts], counts)
        columns = [
            pa.array(np.concatenate([p[0] for p in parts]).view(np.int64)),
            pa.array(np.concatenate([p[1] for p in parts]).view(np.int64), mask=~np.concatenate([p[4] for p in parts])),
            pa.array(np.where(shown, size, -size)),
            *[pa.array(np.ascontiguousarray(both[:, c])) for c in range(3)],
        ]
        return pa.RecordBatch.from_arrays(columns, names=POSTING_NAMES)

    return docs.select("text").mapInArrow(scan, POSTING)


# --- tiles


class Rows:
    """Columns of postings as arrays; ``who`` are the keys of nodes."""

    def __init__(self, table: pa.Table):
        column = {c: table.column(c).combine_chunks() for c in table.column_names}
        column = {c: a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for c, a in column.items()}
        self.tile = column["tile"].to_numpy()
        self.dealt = column["gram"].is_valid().to_numpy(zero_copy_only=False)
        self.gram = np.where(self.dealt, column["gram"].fill_null(0).to_numpy(), self.tile)
        size = column["size"].to_numpy().astype(np.int64)
        self.size, self.shown = np.abs(size), size > 0
        self.who = column["node"].to_numpy()
        self.sig = np.stack([column["sig_a"].to_numpy(), column["sig_b"].to_numpy()], axis=1).view(U64)
        self.label = column["label"].to_numpy() if "label" in column else None


def allowed(r: Rows, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows i (not larger) and j may be linked, by size band, n-grams shown and signatures."""
    a, b = r.size[i], r.size[j]
    fits = (100 * a >= percent * b) & (r.shown[i] | ((a == b) & r.shown[j]))
    fits &= r.who[i] != r.who[j]
    differ = np.bitwise_count(r.sig[i] ^ r.sig[j]).sum(axis=-1, dtype=np.int64)
    return fits & (differ <= a + b - 2 * -(-percent * (a + b) // (100 + percent)))


def runs_of(tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
    return starts, np.diff(np.append(starts, len(tile)))


def sorted_runs(batches: Iterator[pa.RecordBatch], least: int = 100_000) -> Iterator[pa.Table]:
    """The rows of a partition sorted by tile, in tables that end where a tile ends."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < least:
            continue
        table = pa.Table.from_batches(held)
        tile = table.column("tile").to_numpy()
        last = int(np.searchsorted(tile, tile[-1]))  # the sort is ascending
        if last:
            yield table.slice(0, last)
            held, count = table.slice(last).combine_chunks().to_batches(), table.num_rows - last
            least = max(100_000, 2 * count)
        else:
            least = 2 * count
    if count:
        yield pa.Table.from_batches(held)


PAIR = "a long, b long"
#: Columns of nodes as a pair's; its keys join both.
SIDES = (("key_a", "a", "rep_a", "size_a", "wide_a"), ("key_b", "b", "rep_b", "size_b", "wide_b"))


def first_look(percent: int):
    """Pairs to check (a, b), and the rows of large tiles that are set aside."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches):
            tile, node = table.column("tile").to_numpy(), table.column("node").to_numpy()
            dealt = table.column("gram").is_valid().to_numpy()
            new = np.append(True, (tile[1:] != tile[:-1]) | (node[1:] != node[:-1]))
            _, lengths = runs_of(tile[new])
            new[new] = np.repeat(lengths > 1, lengths) | dealt[new]
            if not new.any():
                continue
            r = Rows(table.filter(pa.array(new)))
            starts, lengths = runs_of(r.tile)
            length_of = np.repeat(lengths, lengths)
            left, right, aside = [], [], np.zeros(len(r.tile), bool)
            for lag in range(1, SMALL):
                j = np.arange(lag, len(r.tile))
                j = j[(r.tile[j] == r.tile[j - lag]) & (length_of[j] <= SMALL)]
                ok = allowed(r, j - lag, j, percent)
                left.append(j[ok] - lag)
                right.append(j[ok])
            for s, n in zip(starts[lengths > SMALL].tolist(), lengths[lengths > SMALL].tolist(), strict=True):
                i, j, more = closest(r, s, n, percent)
                left.append(i)
                right.append(j)
                aside[more] = True
            aside |= r.dealt
            i, j = np.concatenate(left), np.concatenate(right)
            yield from told(r, i, j, np.flatnonzero(aside))

    def told(r: Rows, i: np.ndarray, j: np.ndarray, aside: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(i):
            keys = np.sort(np.stack([r.who[i], r.who[j]], axis=1), axis=1)
            both, at, times = np.unique(keys, axis=0, return_index=True, return_counts=True)
            least = common_least(np.minimum(r.size[i], r.size[j])[at])
            none = [pa.nulls(len(both), pa.int64())] * 3
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(np.ascontiguousarray(both[:, c])) for c in (0, 1)], pa.array(times), pa.array(least),
                 none[0], pa.nulls(len(both), pa.int32()), *none[1:]],
                names=LOOKED_NAMES,
            )
        if len(aside):
            size = np.where(r.shown, r.size, -r.size)[aside].astype(np.int32)
            sig = [pa.array(np.ascontiguousarray(r.sig[aside, c]).view(np.int64)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(r.who[aside]), *[pa.nulls(len(aside), pa.int64())] * 3, pa.array(r.gram[aside]), pa.array(size), *sig],
                names=LOOKED_NAMES,
            )

    return scan


#: A pair with how often it met and how often it must, or (b null) a row set aside.
LOOKED = "a long, b long, times long, least long, gram long, size int, sig_a long, sig_b long"
LOOKED_NAMES = [f.split()[0] for f in LOOKED.split(", ")]


def blocks_of(start: int, n: int, pairs: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with i before j among n rows from ``start``, as a block of j against all before it."""
    width = max(1, pairs // n)
    for low in range(0, n, width):
        high = min(n, low + width)
        yield np.arange(start, start + high), np.arange(start + low, start + high)


def closest(r: Rows, start: int, n: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's closest earlier partner, and all rows of pairs if there are more pairs than those."""
    left, right, more = [], [], []
    for before, block in blocks_of(start, n):
        low = np.searchsorted(r.size[before], -(-percent * r.size[block[0]] // 100))
        before = before[low:]
        ok = allowed(r, before[None, :], block[:, None], percent) & (before[None, :] < block[:, None])
        differ = np.bitwise_count(r.sig[before][None] ^ r.sig[block][:, None]).sum(axis=-1, dtype=np.int64)
        best = np.where(ok, differ, 1 << 20).argmin(axis=1)
        has = ok[np.arange(len(block)), best]
        left.append(before[best[has]])
        right.append(block[has])
        if (ok.sum(axis=1) > 1).any():
            more += [block[ok.any(axis=1)], before[ok.any(axis=0)]]
    return np.concatenate(left), np.concatenate(right), np.concatenate([np.zeros(0, np.int64), *more])


def second_look(percent: int):
    """All pairs of rows with different labels that both signatures allow; of two guests none."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tested: set[tuple[int, int]] = set()  # pairs meet in many tiles; one test is enough
        for table in sorted_runs(batches):
            if len(tested) > SEEN:
                tested.clear()
            r = Rows(table)
            pairs: list[tuple[int, int]] = []
            host, wide = table.column("host").to_numpy(), table.column("wide")
            for s, n in zip(*(x.tolist() for x in runs_of(r.tile)), strict=True):
                if (r.label[s : s + n] == r.label[s]).all():
                    continue
                for before, block in blocks_of(s, n):
                    low = np.searchsorted(r.size[before], -(-percent * r.size[block[0]] // 100))
                    before = before[low:]
                    ok = (before[None, :] < block[:, None]) & (r.label[before][None, :] != r.label[block][:, None])
                    ok &= host[before][None, :]
                    jj, ii = np.nonzero(ok)
                    i, j = before[ii], block[jj]
                    keep = allowed(r, i, j, percent)
                    for x in np.flatnonzero(keep).tolist():
                        a, b = i[x], j[x]
                        pair = tuple(sorted((int(r.who[a]), int(r.who[b]))))
                        keep[x] = pair not in tested and within(
                            wide[a].as_py(), wide[b].as_py(), int(r.size[a]), int(r.size[b]), percent
                        )
                        tested.add(pair)
                        if keep[x]:
                            pairs.append(pair)
            if pairs:
                columns = [pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return scan


# --- checking and components


def check(pairs: DataFrame, docs: DataFrame, reps: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b), as representatives' ids, of the pairs of nodes' keys whose sets are as similar as asked."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, *rest = (c.to_pylist() for c in batch.columns[4:])
            keep = [within(*pair, percent) for pair in zip(a, b, *rest, strict=True)]
            kept = pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "rep_a", "rep_b"])
            yield kept.filter(pa.array(keep, pa.bool_()))

    a, b = (reps.select(*[F.col(c).alias(c2) for c, c2 in zip(reps.columns, names, strict=True)]) for names in SIDES)
    pairs = pairs.select(F.col("a").alias("key_a"), F.col("b").alias("key_b")).distinct()
    sized = pairs.join(a, "key_a").join(b, "key_b")
    sized = sized.select("a", "b", "rep_a", "rep_b", "wide_a", "wide_b", "size_a", "size_b")
    pairs = stored(sized.mapInArrow(prune, "a binary, b binary, rep_a long, rep_b long"), "pairs")
    ids = pairs.select(F.col("rep_a").alias("doc_id"), F.col("a").alias("node")).union(pairs.select("rep_b", "b"))
    ids = stored(ids.distinct(), "wanted")
    # Texts aren't shuffled: a bitmap of fixed size lets all wanted documents through, and some others.
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words = ids.select(cell.alias("cell")).groupBy(F.expr("cell div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cell % 64 as int))")).alias("bits")
    )
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    for row in words.collect():  # FILTER_BITS / 64 rows at most
        bitmap[row[0]] = row[1]
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap.view(U64))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            cells = batch.column(2).to_numpy().astype(np.int64)
            batch = batch.filter(pa.array((bits[cells >> 6] >> (cells & 63).astype(U64)) & U64(1) == 1))
            grams = list(gram_sets(strings(batch.column(1)), n))
            columns = [pa.array([digest(g) for g in grams], pa.binary()), pa.array([g.tobytes() for g in grams], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "node", "grams"])

    found = docs.where("doc_id is not null").select("doc_id", "text", cell.cast("long").alias("cell"))
    found = found.mapInArrow(sets, "doc_id long, node binary, grams binary")
    # The node decides too, as a repeated id may have another text.
    arrays = stored(found.join(ids, ["doc_id", "node"]).select("node", "grams"), "sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            kept = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"])
            yield kept.filter(pa.array(keep, pa.bool_()))

    left = arrays.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
    right = arrays.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
    both = pairs.join(left, "a").join(right, "b").select("rep_a", "rep_b", "grams_a", "grams_b")
    return both.mapInArrow(verify, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, label: the smallest id that links (a, b) lead to, for every linked id.

    Star contraction: each id's larger neighbours, then its smaller ones, are tied to the smallest
    neighbour, until nothing changes. Every step is joins and map-side minima; steps are kept in the
    shared folder.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before, now = None, state(edges)
    while before != now:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(tied.union(least.select("u", "m")).distinct(), "links")
        before, now = now, state(edges)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([key_of(batch.column(0)), *batch.columns], names=["key", *batch.schema.names])


def join_near(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id for rows of doc_id, text."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counted = stored(nodes_and_counts(docs, n), "nodes")
    members = counted.where("slice is null").select("doc_id", "n_shingles", "node")
    classes = spark.sparkContext.broadcast(gram_classes(counted))
    reps = counted.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("size"), F.any_value("wide").alias("wide")
    )
    reps = stored(reps.mapInArrow(keyed, "key long, node binary, rep long, size long, wide binary"), "nodes")

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = [fold(x, TILE_BITS) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(folded, pa.binary())], names=["node", "wide"])

    def links_of(pairs: DataFrame, keep: int) -> DataFrame:
        with scratch(spark):
            return stored(check(pairs, docs, reps, n, percent), "links", keep=keep)

    with scratch(spark):
        shown = postings(docs, n, percent, classes).repartition("tile").sortWithinPartitions("tile", F.abs("size"), "node")
        looked = stored(shown.mapInArrow(first_look(percent), LOOKED), "looked")
        # A pair that shares fewer first n-grams than it must is none, unless a large tile hid some of them;
        # then both its rows are set aside.
        met = looked.where("b is not null").groupBy("a", "b").agg(F.sum("times").alias("times"), F.max("least").alias("least"))
        links = links_of(met.where("times >= least").select("a", "b"), keep=2)
        labels = components(links)

        aside = looked.where("b is null").select("gram", "size", F.col("a").alias("node"), "sig_a", "sig_b").distinct()
        keys = reps.select(F.col("key").alias("node"), "rep")
        aside = aside.join(keys, "node").join(labels, F.col("rep") == F.col("id"), "left")
        label = F.coalesce("label", "rep").alias("label")
        aside = stored(aside.select("gram", "size", "node", "sig_a", "sig_b", label), "aside", keep=1)
    mixed = aside.groupBy("gram").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("gram")
    # A set of band k is host there and a guest of band k - 1, whose sets are smaller by up to a band.
    band = F.floor(F.log(F.abs("size").cast("double")) / F.log(F.lit(100.0 / percent)) / 1.000001)
    banded = aside.join(mixed, "gram", "left_semi").withColumn("band", F.explode(F.array(band, band - 1)))
    banded = banded.withColumn("host", F.col("band") == band).withColumn("tile", F.xxhash64("gram", "band"))
    banded = banded.withColumn("gram", F.lit(None).cast("long"))
    wide = reps.select(F.col("key").alias("node"), "wide").mapInArrow(narrow, "node long, wide binary")
    banded = banded.join(wide, "node")
    again = banded.select(*POSTING_NAMES, "label", "host", "wide").repartition("tile")
    again = again.sortWithinPartitions("tile", F.abs("size"))
    more = again.mapInArrow(second_look(percent), PAIR)
    labels = components(links.union(links_of(more, keep=1)))

    found = members.join(reps.select("node", "rep"), "node", "left").join(labels, F.col("rep") == F.col("id"), "left")
    return found.select("doc_id", "n_shingles", F.coalesce("label", "rep", "doc_id").alias("component_id"))

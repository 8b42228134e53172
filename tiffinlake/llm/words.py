"""Words of many texts at once, as 64-bit hashes, straight from Arrow's buffers.

Words are runs of characters other than blanks and line breaks; only A-Z are lower-cased. UTF-8 keeps
those bytes out of longer characters, so bytes will do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Text bytes hashed at once.
STRETCH = 1 << 21
U64 = np.uint64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240117)
    values = rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    values[65:91] = values[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return values, space


VALUES, IS_SPACE = _tables()
BASE = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, U64), np.full(max(n - 1, 0), BASE)]), dtype=U64)


def hash_words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its first byte's place); ``first`` marks where documents begin."""
    inside = ~IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, U64), at
    starts = np.flatnonzero(begins[at])
    lengths = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    values = VALUES[data[at]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, starts) + lengths.astype(U64)), at[starts]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words per document), a stretch of bytes at a time."""
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    hashes, places, low = [], [], 0
    while low < len(data):
        high = min(len(data), low + STRETCH)
        while high < len(data) and not (first[high] or IS_SPACE[data[high]]):
            high += 1
        h, p = hash_words(data[low:high], first[low:high])
        hashes.append(h)
        places.append(p + low)
        low = high
    if not hashes:
        return np.zeros(0, U64), np.zeros(len(offsets) - 1, np.int64)
    bounds = np.searchsorted(np.concatenate(places), offsets)
    return np.concatenate(hashes), np.diff(bounds)


def strings(column: pa.Array) -> pa.Array:
    """The column as strings with 32-bit offsets, nulls empty."""
    return column.cast(pa.string()).fill_null("")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last ends) of a column from ``strings``."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int32)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]

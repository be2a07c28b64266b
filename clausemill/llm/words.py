"""Vectorised word scanning over Arrow text columns.

A column's documents are handled in blocks of half a MB: numpy finds word borders with a
table of 256 byte classes and hashes all words of a block at once.  Texts are never cut:
a block holds whole documents, so a very long one is a block of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_PRIME = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

#: A-Z to a-z, every other byte as it is.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: UTF-8 bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: UTF-8 bytes of ``[^\x20\x09-\x0D]``.
NON_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits (64-bit, wraps around)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_blocks(column, block_bytes: int = BLOCK_BYTES):
    """Yields (first row, bytes as uint8, offsets of its rows and the end) of an Arrow
    string array.  Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def texts_of(batch) -> pa.Array:
    """The text column of a batch, or that of its struct column ``row``, as strings."""
    if "text" in batch.schema.names:
        return batch.column("text")
    row = batch.column("row")
    names = [row.type.field(k).name for k in range(row.type.num_fields)]
    return row.field(names.index("text")).cast(pa.string())


def word_borders(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Starts and ends of all words and, for each row, the index of its first word (with
    the number of words last).  No word reaches over a row's end."""
    m = is_word[data]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = m[inner]
    last[inner - 1] = m[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


class WordHasher:
    """64-bit hashes of many byte ranges of one buffer through prefix sums."""

    def __init__(self):
        self.size = 0

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, BLOCK_BYTES + (1 << 16))
            inverse = np.uint64(pow(_PRIME, -1, 1 << 64))
            self.power = np.empty(self.size, np.uint64)
            self.inverse = np.empty(self.size, np.uint64)
            self.power[0] = self.inverse[0] = 1
            with np.errstate(over="ignore"):
                self.power[1:], self.inverse[1:] = np.uint64(_PRIME), inverse
                np.multiply.accumulate(self.power, out=self.power)
                np.multiply.accumulate(self.inverse, out=self.inverse)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=total[1:])
        return total

    def ranges(self, total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((total[ends] - total[starts]) * self.inverse[starts])

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.ranges(self.prefix(data), starts, ends)


def hash_word(word: str) -> int:
    """The hash ``WordHasher`` gives the word, which is expected in lower case."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(WordHasher()(data, np.array([0]), np.array([len(data)]))[0])


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each position (those that run over a row's end
    are in the result too; callers mask them)."""
    count = max(0, len(words) - n + 1)
    h = np.zeros(count, np.uint64)
    for k in range(n):
        h = mix(h + words[k : k + count] * np.uint64((2 * k + 3) * 0x9E3779B97F4A7C15 & _MASK))
    return h

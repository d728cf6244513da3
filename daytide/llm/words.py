"""Words and rolling hashes of whole Arrow string columns, in NumPy.

A column is taken as one byte buffer with offsets, so that no Python object is made for
a word. Work goes in blocks of about ``block`` bytes cut between words, which bounds the
memory beside the result (eight bytes a word) however long a single text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)

#: Bytes that end a word of `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Maps A-Z to a-z and every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_KEPT: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers, modulo 2^64; the tables of usual blocks are kept."""
    kept = _KEPT.get(int(base), ())
    if len(kept) < n:
        kept = np.full(n + n // 8, base, np.uint64)
        kept[:1] = 1
        np.multiply.accumulate(kept, out=kept)
        if n <= 1 << 21:
            _KEPT[int(base)] = kept
    return kept[:n]


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _cuts(data, offsets, separator, block):
    """Block ends that split no word."""
    at, n = 0, len(data)
    while at < n:
        end, look = min(n, at + block), min(block, 256)
        while end < n:
            # the next separator or text start at or after end
            ahead = np.flatnonzero(separator[data[end : end + look]])
            starts = np.searchsorted(offsets, end)
            start = int(offsets[starts]) if starts < len(offsets) else n
            found = end + int(ahead[0]) if len(ahead) else min(n, end + look)
            if start <= found:
                end = start
                break
            end, look = found, min(block, 2 * look)
            if len(ahead):
                break
        yield at, end
        at = end


class Words:
    """Hash, text number and byte span of every word, in order."""

    def __init__(self, column, separator=SPACES, lower: bool = False, block: int = 1 << 20):
        self.data, self.offsets = buffer_of(column)
        data, offsets = self.data, self.offsets
        fold = np.where(separator, np.uint64(0), _BYTES[LOWER] if lower else _BYTES)
        hashes, begins, ends = [], [], []
        for a, b in _cuts(data, offsets, separator, block):
            part = data[a:b]
            inside = ~separator[part]
            edge = np.zeros(b - a + 1, bool)
            edge[0] = edge[-1] = True
            lo, hi = np.searchsorted(offsets, [a, b + 1])
            edge[offsets[lo:hi] - a] = True
            before = np.empty(b - a, bool)
            before[0] = False
            before[1:] = inside[:-1]
            first = np.flatnonzero(inside & (~before | edge[:-1]))
            if not len(first):
                continue
            after = np.zeros(b - a, bool)
            after[:-1] = inside[1:]
            last = np.flatnonzero(inside & (~after | edge[1:])) + 1
            length = last - first
            # powers go by the place in the block; those up to the word's begin are taken back
            value = fold[part]
            value *= _powers(_STEP, b - a)
            summed = np.add.reduceat(value, first)
            summed *= _powers(_BACK, int(first[-1]) + 1)[first]
            hashes.append(mixed(summed + length.astype(np.uint64) * _ODD))
            begins.append(first + a)
            ends.append(last + a)
        empty = np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.begin = np.concatenate(begins) if begins else empty
        self.end = np.concatenate(ends) if ends else empty
        #: First word of each text, and one past the last word of the last text.
        self.first = np.searchsorted(self.begin, offsets).astype(np.int64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_number(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words by first word, and which of them lie in one text."""
        total = len(self.hash)
        out = np.zeros(max(0, total - n + 1), np.uint64)
        for j in range(n):
            out *= _STEP
            out += self.hash[j : j + len(out)]
        number = self.text_number()
        inside = number[: len(out)] == number[n - 1 :] if len(out) else np.zeros(0, bool)
        return mixed(out + np.uint64(n)), inside


def parts(batches, column: str = "text", limit: int = 4 << 20):
    """Record batches cut to about ``limit`` bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(upto[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + limit, "right")))
            yield batch.slice(at, end - at)
            at = end

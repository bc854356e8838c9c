"""Words, hashes and n-grams of many texts at once, as numpy arrays inside a task.

A word is a maximal run of bytes other than space and 0x09-0x0D; with ``lower`` the letters
A-Z count as a-z. Texts are handled in pieces of about ``PIECE`` bytes, so memory follows the
piece (or the longest single text), not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, near inputs scatter."""
    z = x + U64((_BASE * (seed + 1)) & (2**64 - 1))
    z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


_BYTE = mix(np.arange(256, dtype=U64), 7)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


_BYTES = _Powers(0xD1342543DE82EF95)
_GRAMS = _Powers(0xAF251AF3B0F025B5)


@dataclass
class Words:
    """All words of a run of texts. ``first[i]:first[i + 1]`` are the words of text ``i``."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Index of the text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def left(self) -> np.ndarray:
        """How many words each text still has from each word on, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.hash))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts in a row and the offset of each; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = raw(texts)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), none, none, np.zeros(len(offsets), np.int64), data)
    separator = _SEPARATOR[data]
    before = np.empty(n + 1, bool)
    before[0] = True
    before[1:] = separator
    before[offsets] = True  # a text also begins and ends words
    start = np.flatnonzero(before[:-1] & ~separator)
    after = np.empty(n, bool)
    after[:-1] = separator[1:]
    after[-1] = True
    inner = offsets[(offsets > 0) & (offsets < n)]
    after[inner - 1] = True
    end = np.flatnonzero(after & ~separator) + 1
    _BYTES.upto(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _BYTES.up[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _BYTES.down[start])
    return Words(hashes, start, end, np.searchsorted(start, offsets), data)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on (across texts: mask with ``left() >= k``)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64)
    _GRAMS.upto(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(hashes * _GRAMS.up[:n], out=sums[1:])
    at = np.arange(n - k + 1)
    return mix((sums[at + k] - sums[at]) * _GRAMS.down[at], k)


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles of each text, sorted within it, and where each text's begin.

    A text of fewer than ``k`` words has its whole sequence as its one shingle, an empty text none.
    """
    n_texts = len(w.first) - 1
    counts = w.counts
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.zeros(n_texts + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    out = np.empty(at[-1], U64)
    g = grams(w.hash, k)
    whole = w.left() >= k
    out_long = np.repeat(counts >= k, sizes)
    out[out_long] = g[whole[: len(g)]]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        out[at[i]] = grams(w.hash[w.first[i] : w.first[i + 1]], int(counts[i]))[0]
    for i in range(n_texts):
        out[at[i] : at[i + 1]].sort()
    if len(out) == 0:
        return out, at
    new = np.empty(len(out), bool)
    new[0] = True
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][sizes > 0]] = True
    kept = np.zeros(len(out) + 1, np.int64)
    np.cumsum(new, out=kept[1:])
    return out[new], kept[at]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each (one long text may hold more)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = raw(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end

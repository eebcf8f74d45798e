"""Word and shingle hashes of whole Arrow text columns in numpy, without a Python step for each word.

A word's hash is a polynomial over its bytes (mod 2^64, random table and odd base), mixed
with its length; a shingle's hash is a polynomial over its words' hashes. Columns are worked
through in slices of about SLICE bytes, so memory stays the same for any batch. A longer
document is a slice of its own, whose bytes are hashed in windows of SLICE: beside the text
there are 24 bytes a word then, and 9 a word for shingles. A word over a window's end, or over
several, goes on with the sum that it had there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
#: Shingles that are hashed at once.
STARTS = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _range_sums(values: np.ndarray, base: np.uint64, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """sum(values[i] * base**(i - start)) over each [start, end), mod 2^64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=total[1:])
    return (total[end] - total[start]) * _powers(_inverse(base), len(values) + 1)[start]


@dataclass
class Words:
    """The words of some consecutive documents. Words of document i: first[i]:first[i + 1]."""

    lo: int  # row of the first document in its batch
    data: np.ndarray  # the texts' bytes
    offsets: np.ndarray  # of the documents in data, one more than documents
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word windows by the index of their first word (the last k - 1 of each document aren't windows), and which are windows."""
        m = len(self.hash)
        ok = np.ones(m, bool)
        for back in range(1, min(k, m + 1)):
            at = self.first[1:] - back
            ok[at[at >= self.first[:-1]]] = False
        out = np.zeros(m, np.uint64)
        for lo in range(0, m, STARTS):
            s = np.flatnonzero(ok[lo : lo + STARTS])
            if len(s):
                out[lo + s] = mix(_range_sums(self.hash[lo : lo + STARTS + k - 1], _STEP, s, s + k))
        return out, ok


def _words(lo: int, data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    n = len(data)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    open_at, open_sum = 0, 0  # of a word that the window before cut
    cut = False
    for p in range(0, n, SLICE):
        q = min(p + SLICE, n)
        piece = data[p:q]
        word = ~SPACE[piece]
        edges = offsets[np.searchsorted(offsets, p, "left") : np.searchsorted(offsets, q, "right")] - p
        before, after = np.ones(q - p, bool), np.ones(q - p, bool)
        before[1:] = ~word[:-1]
        before[edges[edges < q - p]] = True
        after[:-1] = ~word[1:]
        after[edges[edges > 0] - 1] = True
        start, end = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
        values = _TABLE[_LOWER[piece] if lower else piece]
        sums = _range_sums(values, _BASE, start, end)
        start += p
        end += p
        goes_on = cut and bool(word[0]) and not (len(edges) and edges[0] == 0)
        if goes_on:
            sums[0] = (open_sum + int(sums[0]) * pow(int(_BASE), p - open_at, 1 << 64)) % (1 << 64)
            start[0] = open_at
        elif cut:  # the word ended with its window
            found.append((np.array([open_at]), np.array([p]), np.array([open_sum], np.uint64)))
        cut = q < n and bool(word[-1])
        if cut:
            open_at, open_sum = int(start[-1]), int(sums[-1])
            start, end, sums = start[:-1], end[:-1], sums[:-1]
        found.append((start, end, sums))
    if not found:
        found.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)))
    start, end, hashes = (np.concatenate(x) if len(found) > 1 else x[0] for x in zip(*found, strict=True))
    for at in range(0, len(hashes), STARTS):
        part = slice(at, at + STARTS)
        hashes[part] = mix(hashes[part] + (end[part] - start[part]).astype(np.uint64) * _STEP)
    return Words(lo, data, offsets, start, end, np.searchsorted(start, offsets), hashes)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null as the empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(column: pa.Array, lower: bool = False, size: int = SLICE) -> Iterator[Words]:
    """Words of a text column by slices of whole documents. lower: A-Z count as a-z."""
    raw, offsets = text_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        part = offsets[lo : hi + 1]
        yield _words(lo, raw[part[0] : part[-1]], part - part[0], lower)
        lo = hi

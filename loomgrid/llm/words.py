"""Vectorised word arithmetic over Arrow text columns.

A word is a maximal run of bytes other than space and the controls 0x09-0x0D.
The UTF-8 buffer of a whole Arrow batch is handled at once: words are hashed eight
bytes at a time, windows of a few words by Horner's rule over word hashes, longer
ones by a polynomial prefix sum, which gives the hash of any range in constant
time. All sums wrap modulo 2**64; the base is odd, so its inverse exists and a
range's hash does not depend on where the range starts. A final step spreads bits.

Results that name words, shingles or windows as equal compare these 64-bit hashes
and not the words again. Two different ones agree by chance once in 2**64; prefix
sums modulo 2**64 can be made to agree on purpose, but only over ranges of more
than a thousand items, and ranges here are windows of at most a few dozen words,
or lines of text (quality statistics) and the bytes of a word after its first LONG.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
CHUNK = 1 << 18
#: Windows of at most so many words are hashed without prefix sums.
DIRECT = 8
#: Bytes of a word that are hashed one step after another.
LONG = 512
#: Masks of the first 0 to 8 bytes of a little-endian number.
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], U)

def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _separators(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | (data - np.uint8(9) <= 4)


def _lower(data: np.ndarray) -> np.ndarray:
    return data | ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


@lru_cache(maxsize=8)
def _power_table(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    size = 1 << 16
    while size < n:
        size *= 2
    return _power_table(base, size)[:n]


def inverse(base: int, n: int) -> np.ndarray:
    return powers(pow(base, -1, 1 << 64), n)


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def ranges(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the ranges [lo, hi)."""
    return mix((sums[hi] - sums[lo]) * inverse(base, len(sums))[lo])


class Words:
    """The words of a slice of a text column.

    data: bytes; at: offsets of the documents in it; lo, hi: byte range of each
    word; first: index of each document's first word, with an end; doc: the
    document of each word; hash: of each word.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, hashes: bool = True):
        wide = pa.types.is_large_string(texts.type)
        size, n = (8 if wide else 4), len(texts)
        buf = texts.buffers()
        at = np.frombuffer(buf[1], np.int64 if wide else np.int32, n + 1, texts.offset * size).astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(buf[2], np.uint8, at[-1] - at[0], at[0]) if n and buf[2] is not None else np.zeros(0, np.uint8)
        self.raw, self.at, self.n = data, at - at[0], n
        self.data = data = _lower(data) if lower else data
        self.inside = inside = ~_separators(data)
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        edge = self.at[:-1][self.at[:-1] < len(data)]
        begin[edge] = inside[edge]
        edge = self.at[1:][self.at[1:] > 0] - 1
        stop[edge] = inside[edge]
        self.lo, self.hi = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.lo, self.at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)
        if hashes:
            self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """Hash of each word, eight bytes at a time; only words with more bytes take another step."""
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        size = self.hi - self.lo
        out = mix((eight[self.lo] & _KEEP[np.minimum(size, 8)]) + size.astype(U) * U(WORD_BASE))
        more, step = np.flatnonzero(size > 8), 8
        while len(more):
            out[more] = mix((out[more] * U(BASE)) ^ (eight[self.lo[more] + step] & _KEEP[np.minimum(size[more] - step, 8)]))
            step += 8
            more = more[size[more] > step]
            if step >= LONG and len(more):  # the rest of very long words at once
                out[more] = mix(out[more] ^ ranges(self.sums, self.lo[more] + step, self.hi[more], BASE))
                break
        return out

    @cached_property
    def sums(self) -> np.ndarray:
        """Prefix sums over bytes, for hashes of byte ranges by ranges(sums, lo, hi, BASE)."""
        return prefix(self.data.astype(U) + U(1), BASE)

    def starts(self, k: int) -> np.ndarray:
        """First words of all windows of k words within one document."""
        m = len(self.lo) - k + 1
        return np.flatnonzero(self.doc[:m] == self.doc[k - 1 :]) if m > 0 else np.zeros(0, np.int64)

    @cached_property
    def word_sums(self) -> np.ndarray:
        return prefix(self.hash, WORD_BASE)

    def windows(self, k: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows of k words that start at these words."""
        if k > DIRECT:
            return ranges(self.word_sums, at, at + k, WORD_BASE) + U(k)
        m = len(self.hash) - k + 1
        if m < 1:
            return np.zeros(0, U)
        out = self.hash[:m]
        for j in range(1, k):
            out = out * U(WORD_BASE) + self.hash[j : m + j]
        return mix(out if len(at) == m else out[at]) + U(k)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word and hash of each shingle of k words; a shorter
        document with words has its whole word sequence as its only shingle."""
        at = self.starts(k)
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        doc, h = self.doc[at], self.windows(k, at)
        if len(short):
            a = self.first[short]
            extra = ranges(self.word_sums, a, a + self.count[short], WORD_BASE) + U(k) + self.count[short].astype(U) + U(1)
            doc, at, h = np.concatenate([doc, short]), np.concatenate([at, a]), np.concatenate([h, extra])
            order = np.argsort(doc, kind="stable")
            doc, at, h = doc[order], at[order], h[order]
        return doc, at, h

    def totals(self, per_byte: np.ndarray) -> np.ndarray:
        """Sums of a value of each byte, by document."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(per_byte, out=sums[1:])
        return np.diff(sums[self.at])


def text_bytes(texts: pa.Array) -> np.ndarray:
    n, wide = len(texts), pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not n:
        return np.zeros(0, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, n + 1, texts.offset * (8 if wide else 4))
    return np.diff(at).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about this many bytes of text, or one row."""
    for batch in batches:
        ends = np.cumsum(text_bytes(batch.column(column)))
        i = 0
        while i < batch.num_rows:
            done = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + budget, side="right")))
            yield batch.slice(i, j - i)
            i = j


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return batch.column(column)

"""Benchmark decontamination by SimHash of item-sized windows.

Words are lowered in A-Z; a text's features are its shingles of five words. For
each benchmark item, documents are read through windows of as many words as the
item has, at every start where the window holds at least one of the item's
shingles (elsewhere the similarity is 0). A window's SimHash comes from prefix
sums of the bits of its shingles. A multi-index finds the items of that size near
it: fingerprints fall into BLOCKS blocks, and one within RADIUS bits must be
within RADIUS // BLOCKS bits in at least one of them, so looking up every block's
neighbourhood misses none. Candidates are verified by the exact similarity of
shingle multisets: the sum of the lower counts over the sum of the higher ones.

At similarity 0.8 two fingerprints differ in 10 of 64 bits on average, with a
standard deviation of 3, so that RADIUS leaves out about one in a million.

Defined results: a document shorter than an item is one window. An item of fewer
than five words has one shingle, all its words, and matches every document in
which these words follow each other. Items and documents without words match
nothing. An item with a null id still counts. Repeated rows give their results
each. Empty tables give no rows, or keep all documents. Very long texts are read
whole: windows are taken STEP at a time, so that memory grows with the text and
not with its windows times the item's words. Extra columns of any name are ignored
by matches() and kept by clean().

The benchmark is a query set: it is dealt into blocks of at most MAX_ITEMS items,
and each block is sent to all tasks in turn, however many there are. Its shingles
and fingerprints are sent; each task makes the multi-index of a group of at most
GROUP items of one size when it needs it, and keeps a few.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm.ordered import small_batches
from loomgrid.llm.words import Words, mix, slices

WORDS, SIMILARITY = 5, 0.8
BITS, RADIUS, BLOCKS = 64, 24, 4
MAX_ITEMS, GROUP, KEPT = 20_000, 1_024, 4
#: Windows read at a time, and shingles of windows compared at a time.
STEP, CELLS = 4_096, 1 << 19
U = np.uint64


def _signs(hashes: np.ndarray) -> np.ndarray:
    """Bits of the hashes as 1 and -1."""
    return np.unpackbits(mix(hashes).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(sums > 0, axis=1)).view(U).reshape(-1)


class Items:
    """A block of the benchmark: shingles of its items, their fingerprints and the multi-index of each size."""

    def __init__(self, texts: pa.Array, k: int = WORDS):
        self.k = k
        w = Words(texts, lower=True)
        doc, _, h = w.shingles(k)
        self.size = w.count  # words of each item
        full = w.count[doc] >= k if len(doc) else np.zeros(0, bool)
        self.short: dict[int, dict[int, list[int]]] = {}
        for d in doc[~full].tolist():
            n = int(w.count[d])
            self.short.setdefault(n, {}).setdefault(int(w.windows(n, w.first[d : d + 1])[0]), []).append(d)
        doc, h = doc[full], h[full]
        order = np.argsort(h, kind="stable")
        self.hash, self.owner = h[order], doc[order]
        self.features = np.bincount(doc, minlength=w.n)
        self.own = {}
        self.print = np.zeros(w.n, U)
        for t in np.unique(doc):
            mine = h[doc == t]
            self.own[int(t)] = np.unique(mine, return_counts=True)
            self.print[t] = _pack(_signs(mine).sum(0, keepdims=True))[0]
        self.index = {int(n): np.flatnonzero((w.count == n) & (self.features > 0)) for n in np.unique(w.count[doc])}
        self.made: dict[tuple[int, int], list[np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"made": {}}

    def _blocks(self, n: int, g: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """A group of items of n words; for each block and each of its values, which of them have a block near it, as bits."""
        items = self.index[n][g * GROUP : (g + 1) * GROUP]
        if (n, g) not in self.made:
            width = BITS // BLOCKS
            near = []
            for b in range(BLOCKS):
                own = ((self.print[items] >> U(b * width)) & U((1 << width) - 1)).astype(np.uint16)
                values = np.arange(1 << width).astype(np.uint16).reshape(-1, 1 << 10, 1)
                near.append(np.concatenate([np.packbits(np.bitwise_count(v ^ own) <= RADIUS // BLOCKS, axis=1) for v in values]))
            if len(self.made) >= KEPT:
                self.made.pop(next(iter(self.made)))
            self.made[n, g] = near
        return items, self.made[n, g]

    def candidates(self, n: int, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each item of n words near some of the fingerprints: which."""
        width = BITS // BLOCKS
        for g in range(-(-len(self.index[n]) // GROUP)):
            items, near = self._blocks(n, g)
            hit = np.zeros((len(prints), near[0].shape[1]), np.uint8)
            for b, table in enumerate(near):
                hit |= table[((prints >> U(b * width)) & U((1 << width) - 1)).astype(np.int64)]
            for j, t in enumerate(items):
                some = np.flatnonzero(hit[:, j // 8] & (128 >> (j % 8)))
                some = some[np.bitwise_count(prints[some] ^ self.print[t]) <= RADIUS]
                if len(some):
                    yield int(t), some

    def similarity(self, t: int, shingles: np.ndarray, lo: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Exact similarity of an item and windows of these lengths in a list of shingles."""
        keys, counts = self.own[t]
        out = np.zeros(len(lo))
        step = max(1, CELLS // (int(length.max(initial=1)) + len(keys)))
        for i in range(0, len(lo), step):
            a, n = lo[i : i + step], length[i : i + step]
            row = np.repeat(np.arange(len(a)), n)
            own = shingles[np.arange(len(row)) - np.repeat(np.cumsum(n) - n - a, n)]
            place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            met = keys[place] == own
            table = np.bincount(row[met] * len(keys) + place[met], minlength=len(a) * len(keys)).reshape(len(a), len(keys))
            both = np.minimum(table, counts).sum(1)
            out[i : i + step] = both / (n + self.features[t] - both)
        return out

    def leaks(self, texts: pa.Array, similarity: float = SIMILARITY) -> list[tuple[int, int, float, int, int]]:
        """Row, item, similarity, first word and words of the best window, for each pair that reaches the similarity."""
        k, w, found = self.k, Words(texts, lower=True), {}
        for n, items in self.short.items():
            at = w.starts(n)
            h = w.windows(n, at)
            for i in np.flatnonzero(np.isin(h, np.array(list(items), U))).tolist():
                d = int(w.doc[at[i]])
                for t in items[int(h[i])]:
                    found.setdefault((d, t), (1.0, int(at[i] - w.first[d]), n))
        at = w.starts(k)
        if not len(at) or not len(self.hash):
            return [(*x, *y) for x, y in sorted(found.items())]
        h = w.windows(k, at)
        lo = np.searchsorted(self.hash, h)
        anchor = np.flatnonzero(self.hash[np.minimum(lo, len(self.hash) - 1)] == h)
        if not len(anchor):
            return [(*x, *y) for x, y in sorted(found.items())]
        # each anchor with each item that has its shingle, once
        many = np.searchsorted(self.hash, h[anchor], side="right") - lo[anchor]
        pos = np.repeat(anchor, many)
        item = self.owner[np.arange(len(pos)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[anchor], many)]
        doc = w.doc[at[pos]]
        first, rest = w.first[doc], w.count[doc]
        n = self.size[item]
        low = np.maximum(first, at[pos] - (n - k))
        high = np.where(rest >= n, np.minimum(at[pos], first + rest - n), first)
        low = np.where(rest >= n, np.minimum(low, high), first)
        for size in np.unique(n):
            mine = n == size
            # the union of the ranges of starts of this size
            a, b = low[mine], high[mine]
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.concatenate([[True], a[1:] > b[:-1] + 1])
            a, b = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
            # runs of starts, cut to STEP and read as many at a time
            many = b - a + 1
            runs = -(-many // STEP)
            turn = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            a = np.repeat(a, runs) + turn * STEP
            b = np.minimum(a + STEP - 1, np.repeat(b, runs))
            group = (np.cumsum(b - a + 1) - 1) // STEP
            for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(group)) + 1):
                self._read(w, h, at, int(size), a[part], b[part], similarity, found)
        return [(*x, *y) for x, y in sorted(found.items())]

    def _read(self, w: Words, h: np.ndarray, at: np.ndarray, size: int, a: np.ndarray, b: np.ndarray, similarity: float, found: dict) -> None:
        """Judges the windows of an item's size that start in runs of words, from a to b, in order."""
        k, many = self.k, b - a + 1
        start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - a, many)
        doc = w.doc[start]
        length = np.minimum(size, w.first[doc] + w.count[doc] - start) - k + 1
        start, doc, length = start[length > 0], doc[length > 0], length[length > 0]
        if not len(start):
            return
        # the shingles in some window, one after another, and the sums of their bits
        lo = np.searchsorted(at, start)
        base, top = int(lo.min()), int((lo + length).max())
        edge = np.bincount(lo - base, minlength=top - base + 1) - np.bincount(lo + length - base, minlength=top - base + 1)
        used = np.cumsum(edge[:-1]) > 0
        place = np.concatenate([[0], np.cumsum(used)])
        sums = np.zeros((int(place[-1]) + 1, BITS), np.int32)
        np.cumsum(_signs(h[base:top][used]), axis=0, out=sums[1:])
        p = place[lo - base]
        prints = _pack(sums[p + length] - sums[p])
        for t, some in self.candidates(size, prints):
            s = self.similarity(t, h, lo[some], length[some])
            for j in np.flatnonzero(s >= similarity - 1e-12):
                i = some[j]
                key, value = (int(doc[i]), t), (float(s[j]), int(start[i] - w.first[doc[i]]), int(length[i] + k - 1))
                if key not in found or (value[0], -value[1]) > (found[key][0], -found[key][1]):
                    found[key] = value


def blocks(benchmark: DataFrame, most: int = MAX_ITEMS) -> Iterator[tuple[list, Items]]:
    """Ids and index of each block of items that have words."""
    rows = benchmark.select("item_id", "text").filter("text is not null")
    many = -(-rows.count() // most)
    for b in range(many):
        got = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == b).orderBy("item_id", "text").toArrow().combine_chunks()
        yield got.column("item_id").to_pylist(), Items(pa.array(got.column("text").to_pylist(), pa.string()))


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, first_word and n_words of the best window, for each document and item that it holds."""
    spark = docs.sparkSession
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"], T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])

    def scan(ids, shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                rows = shared.value.leaks(b.column("text"), similarity)
                if rows:
                    d, t, s, first, n = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), pa.array([ids[x] for x in t], pa.int64()), pa.array(s), pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=schema.names)

        return small_batches(docs).select("doc_id", "text").mapInArrow(run, schema)

    found = []
    for ids, items in blocks(benchmark):
        found.append(scan(ids, spark.sparkContext.broadcast(items)))
        del items
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that hold no item, with all their columns."""

    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                ok = np.ones(b.num_rows, bool)
                ok[[x[0] for x in shared.value.leaks(b.column("text"), similarity)]] = False
                yield b.filter(pa.array(ok))

        return run

    for _, items in blocks(benchmark):
        docs = small_batches(docs).mapInArrow(keep(docs.sparkSession.sparkContext.broadcast(items)), docs.schema)
    return docs

"""Suffix-array dedup: passages of MIN_WORDS words or more that documents share.

A full suffix array holds a row for every word. Here suffixes are kept only at
minimisers: of every MIN_WORDS - KEY + 1 neighbouring words the one whose
four-word hash is least, a choice that depends on content alone, so that every
passage of MIN_WORDS words keeps the same suffixes wherever it stands. Suffixes
are sorted by the hash of their first KEY words and compared with their
neighbours; those that agree with one of another text are seeds. Each seed is
extended to the left and the right to all windows of MIN_WORDS words of which it
is the minimiser. Sorting and comparing these
in turn leaves the windows that other texts hold too; their union is the result.
So a word is reported if and only if it lies in a window of MIN_WORDS words that
occurs in two documents or more.

Equal texts are one text to the search, and repeated from end to end; their
copies get its passages by a join. Sorting deals rows by ranges of (hash, text,
position), so that a passage that a third of all documents share covers many
partitions; what a partition cannot tell at its two ends is settled between them.

Defined results: null, empty and shorter texts have no passages. Repeats within
one document alone do not count. A repeated row is a copy. A null doc_id is kept.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm.ordered import cut, parts
from loomgrid.llm.words import Words, slices

MIN_WORDS, KEY, ORDER_WORDS = 50, 26, 4


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def minimisers(w: Words, min_words: int = MIN_WORDS, key: int = KEY) -> tuple[np.ndarray, np.ndarray]:
    """The first words of all windows of min_words words, and the word at which each one's suffix is kept: its first minimiser."""
    span, m = min_words - key + 1, len(w.lo) - min_words + 1
    if m < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the place in the low bits makes the first of equal hashes the least, and tells where it is
    n = m + span - 1
    low = np.uint64((1 << max(24, n.bit_length())) - 1)
    h = (w.windows(ORDER_WORDS, np.arange(n)) & ~low) | np.arange(n).astype(np.uint64)
    at = np.flatnonzero(w.doc[:m] == w.doc[min_words - 1 :])
    return at, (_least(h, span)[at] & low).astype(np.int64)


def shared(rows: DataFrame, odd: bool = False) -> DataFrame:
    """The rows of (key, text, pos) whose key occurs with another text, by sorting and comparing neighbours; equal rows count once in a batch.

    odd: only those of odd pos, though all are compared.
    """
    order = ["key", "text", "pos"]
    dealt = rows.repartitionByRange(parts(rows), *order).sortWithinPartitions(*order)
    names = [*order, "state"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # state 1: shared; 0: undecided, as the key is the first or last of the partition; -1: marks a shared key at such a place
        ready: list[tuple[list[np.ndarray], int]] = []
        group: dict = {}

        def kept(cols: list[np.ndarray]) -> list[np.ndarray]:
            return [c[cols[2] % 2 == 1] for c in cols] if odd else cols

        def extend(cols: list[np.ndarray]) -> None:
            if not group["sure"] and group["text"] == cols[1][-1]:
                group["held"].append(cols)
                return
            group["sure"] = True
            ready.extend((kept(x), 1) for x in [*group["held"], cols])
            group["held"] = []

        def begin(cols: list[np.ndarray], first: bool) -> None:
            group.update(key=cols[0][0], text=cols[1][0], sure=False, held=[], first=first, mark=[c[:1] for c in cols])
            extend(cols)

        def end(last: bool) -> None:
            if group["first"] or last:
                ready.extend([(group["mark"], -1)] if group["sure"] else [(x, 0) for x in group["held"]])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            fresh = np.ones(len(cols[0]), bool)
            fresh[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            cols = [c[fresh] for c in cols]
            n, key, text = len(cols[0]), cols[0], cols[1]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            head = new[1] if len(new) > 1 else n
            own = [c[:head] for c in cols]
            if group and group["key"] == key[0]:
                extend(own)
            else:
                if group:
                    end(False)
                begin(own, not group)
            if len(new) > 1:
                end(False)
                stop = np.append(new[1:], n)
                many = (text[new] != text[stop - 1])[1:-1]
                middle = np.repeat(many, (stop - new)[1:-1])
                if middle.any():
                    ready.append((kept([c[head : new[-1]][middle] for c in cols]), 1))
                begin([c[new[-1] :] for c in cols], False)
            for x, state in ready:
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x), pa.array(np.full(len(x[0]), state, np.int32))], names=names)
            ready.clear()
        if group:
            end(True)
            for x, state in ready:
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x), pa.array(np.full(len(x[0]), state, np.int32))], names=names)

    found = cut(dealt.mapInArrow(run, "key long, text long, pos int, state int"))
    edges = found.filter("state < 1").groupBy("key").agg(F.min("text").alias("_lo"), F.max("text").alias("_hi"), F.min("state").alias("_least")).filter("_lo <> _hi or _least < 0").select("key")
    settled = found.filter("state = 0").join(edges, "key", "left_semi")
    if odd:
        settled = settled.filter("pos % 2 = 1")
    return found.filter("state = 1").unionByName(settled).select(*order)


def seeds(docs: DataFrame, min_words: int = MIN_WORDS, key: int = KEY) -> DataFrame:
    """key, text and pos of every kept suffix; text: a hash of the document's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column("text"))
            at = np.unique(minimisers(w, min_words, key)[1])
            if len(at):
                doc = w.doc[at]
                own = b.column("_text").to_numpy(zero_copy_only=False)[doc]
                yield pa.RecordBatch.from_arrays([pa.array(w.windows(key, at).view(np.int64)), pa.array(own), pa.array((at - w.first[doc]).astype(np.int32))], names=["key", "text", "pos"])

    return docs.select("text", F.xxhash64("text").alias("_text")).mapInArrow(run, "key long, text long, pos int")


def extended(docs: DataFrame, min_words: int = MIN_WORDS, key: int = KEY) -> DataFrame:
    """key, text and pos of the windows of min_words words of which a seed is the minimiser; docs: text, _text and the seeds' places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column("text"))
            x, at = minimisers(w, min_words, key)
            places = b.column("places")
            mine = w.first[np.repeat(np.arange(b.num_rows), np.diff(places.offsets.to_numpy()))] + places.flatten().to_numpy()
            x = x[np.isin(at, mine)]
            if len(x):
                doc = w.doc[x]
                own = b.column("_text").to_numpy(zero_copy_only=False)[doc]
                yield pa.RecordBatch.from_arrays([pa.array(w.windows(min_words, x).view(np.int64)), pa.array(own), pa.array((x - w.first[doc]).astype(np.int32))], names=["key", "text", "pos"])

    return docs.select("text", "_text", "places").mapInArrow(run, "key long, text long, pos int")


def passages(docs: DataFrame, min_words: int = MIN_WORDS, key: int = KEY) -> DataFrame:
    """doc_id, first_word and n_words of every stretch of words that other documents share."""
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("_text")).filter("text is not null")
    # one document stands for all of equal text
    classes = own.groupBy("_text").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_copies"))
    found = shared(seeds(docs.filter("text is not null"), min_words, key))
    places = found.groupBy("text").agg(F.sort_array(F.collect_set("pos")).alias("places")).withColumnRenamed("text", "_text")
    work = places.join(classes, "_text").select("_text", "_first", "places")
    texts = own.join(work.withColumnRenamed("_text", "_t"), (F.col("_text") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    windows = shared(extended(texts, min_words, key)).select("text", "pos")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, pos in zip(b.column("text").to_pylist(), b.column("starts"), strict=True):
                x = np.sort(pos.values.to_numpy())
                new = np.flatnonzero(np.concatenate([[True], x[1:] > x[:-1] + min_words]))
                last = x[np.append(new[1:], len(x)) - 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), text)), pa.array(x[new].astype(np.int64)), pa.array((last - x[new] + min_words).astype(np.int64))], names=["_text", "first_word", "n_words"])

    spans = windows.groupBy("text").agg(F.collect_set("pos").alias("starts")).mapInArrow(merge, "_text long, first_word long, n_words long")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column("text"), hashes=False)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_text"), pa.array(w.count.astype(np.int64))], names=["doc_id", "_text", "_size"])

    rows = own.mapInArrow(sizes, T.StructType([docs.schema["doc_id"], T.StructField("_text", T.LongType()), T.StructField("_size", T.LongType())]))
    rows = rows.join(classes.filter("_copies > 1").select("_text", "_copies"), "_text", "left").filter(f"_size >= {min_words}")
    whole = rows.filter("_copies is not null").select("doc_id", F.lit(0).cast("long").alias("first_word"), F.col("_size").alias("n_words"))
    parts_ = rows.filter("_copies is null").join(spans, "_text").select("doc_id", "first_word", "n_words")
    return whole.unionByName(parts_)

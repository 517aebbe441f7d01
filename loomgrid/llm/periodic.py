"""Periodic run detection: stretches of words that repeat at a fixed distance.

A run is a stretch whose smallest period is q words, of MIN_TIMES * q words at
least, and MIN_LENGTH, which no neighbouring word extends. Such a stretch of period
p holds more than (MIN_TIMES - 1) * p words in a row that equal the word p further
on, so it covers a point of every grid of that spacing. All pairs (p, grid point) of
all documents of a batch, a harmonic number of them, are laid out at once. Where the
two words agree, NumPy finds how far they agree to the right and to the left by
binary search over prefix hashes, for all pairs in step. What is long enough is
cleared of duplicates: of stretches that span the same words the least period is
kept, which is the smallest one, as two periods of so long a stretch have their
common divisor for a period. The words themselves are compared last.

Prefix hashes are sums modulo two primes below 2**31, of word hashes times powers of
fixed bases. Equal words always agree, so a hash can only make a stretch too long,
never hide it; if words then differ, the document is searched again word by word.

Defined results: null and empty texts have no words and no run. Very long texts are
searched whole, grid pairs in blocks of PAIRS. Repeated rows are searched each. An
empty table gives no rows. Extra columns of any name are ignored. In planted(), a
null doc_id leaves the words as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm.words import Words, slices

MIN_LENGTH, MIN_TIMES = 6, 4
#: Grid pairs that are searched together.
PAIRS = 1 << 20
#: Moduli and bases of the prefix hashes.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_103_515_245, 1_664_525_011)


class Prefixes:
    """Prefix sums of word values times powers of a base, modulo a prime."""

    def __init__(self, values: np.ndarray, prime: int, base: int):
        self.prime, n = prime, len(values) + 1
        power, have = np.ones(n, np.int64), 1
        while have < n:
            step = min(have, n - have)
            power[have : have + step] = power[:step] * pow(base, have, prime) % prime
            have += step
        self.power = power
        self.sums = np.zeros(n, np.int64)
        np.cumsum((values % np.uint64(prime)).astype(np.int64) * power[:-1] % prime, out=self.sums[1:])
        self.sums %= prime

    def same(self, at: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether the words of [at, at + length) agree with those a period further on."""
        near = (self.sums[at + length] - self.sums[at]) % self.prime
        far = (self.sums[at + period + length] - self.sums[at + period]) % self.prime
        return near * self.power[period] % self.prime == far


def _agree(prefixes: list[Prefixes], at: np.ndarray, period: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """The greatest length up to `most` at which both stretches agree, to the right from `at` or to the left before it."""
    low, high = np.zeros(len(at), np.int64), most.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_] + 1) >> 1
        begin = at[open_] - mid if back else at[open_]
        same = prefixes[0].same(begin, mid, period[open_])
        for p in prefixes[1:]:
            same &= p.same(begin, mid, period[open_])
        low[open_] = np.where(same, mid, low[open_])
        high[open_] = np.where(same, high[open_], mid - 1)
    return low


def _grid(first: np.ndarray, count: np.ndarray, min_length: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document, period and word of all grid pairs of the documents, in blocks of about PAIRS."""
    most = np.where(count >= min_length, count // times, 0)
    doc = np.repeat(np.arange(len(count)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    # so many words in a row equal the word a period further on
    step = np.maximum(min_length - period, (times - 1) * period)
    points = np.maximum(0, (count[doc] - period - step) // step + 1)
    done, ends = 0, np.cumsum(points)
    while done < len(doc):
        stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, side="right")))
        n = points[done:stop]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.repeat(np.arange(done, stop), n)
        yield doc[own], period[own], first[doc[own]] + at * step[own] + step[own] - 1
        done = stop


def stretches(values: np.ndarray, first: np.ndarray, count: np.ndarray, min_length: int = MIN_LENGTH, times: int = MIN_TIMES) -> tuple[np.ndarray, ...]:
    """Document, first word, end and period of what the hashes take for runs; words are numbered over all documents."""
    prefixes = [Prefixes(values, p, b) for p, b in zip(PRIMES, BASES, strict=True)]
    found = [np.zeros((4, 0), np.int64)]
    for doc, period, at in _grid(first, count, min_length, times):
        hit = values[at] == values[at + period]
        doc, period, at = doc[hit], period[hit], at[hit]
        end = first[doc] + count[doc]
        right = _agree(prefixes, at, period, end - period - at, False)
        left = _agree(prefixes, at, period, at - first[doc], True)
        start, stop = at - left, at + right + period
        long = stop - start >= np.maximum(min_length, times * period)
        found.append(np.stack([doc, start, stop, period])[:, long])
    rows = np.concatenate(found, axis=1)
    rows = rows[:, np.lexsort(rows[::-1])]
    fresh = np.ones(rows.shape[1], bool)
    fresh[1:] = np.any(rows[:3, 1:] != rows[:3, :-1], axis=0)
    return tuple(rows[:, fresh])


def runs_by_word(words: list, min_length: int = MIN_LENGTH, times: int = MIN_TIMES) -> list[tuple[int, int, int]]:
    """Start, length and period of all runs of a list of words, comparing the words at each distance in turn."""
    code: dict = {}
    x = np.array([code.setdefault(w, len(code)) for w in words], np.int64)
    out: dict[tuple[int, int], int] = {}
    for p in range(1, len(x) // times + 1 if len(x) >= min_length else 1):
        same = np.concatenate([[False], x[:-p] == x[p:], [False]])
        begin, stop = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
        for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
            if b + p - a >= max(min_length, times * p):
                out.setdefault((a, b + p - a), p)
    return sorted((a, n, p) for (a, n), p in out.items())


def runs(own: list[list], values: np.ndarray, min_length: int = MIN_LENGTH, times: int = MIN_TIMES) -> list[list[tuple[int, int, int]]]:
    """Start, length and period of the runs of each document, by start and period. own: their words; values: hashes of all of these in turn."""
    count = np.array([len(w) for w in own], np.int64)
    first = np.cumsum(count) - count
    out: list[list[tuple[int, int, int]]] = [[] for _ in own]
    wrong = set()
    for doc, start, stop, period in zip(*(x.tolist() for x in stretches(values, first, count, min_length, times)), strict=True):
        a, b, words = start - int(first[doc]), stop - int(first[doc]), own[doc]
        out[doc].append((a, b - a, period))
        if words[a : b - period] != words[a + period : b]:
            wrong.add(doc)
    for doc in wrong:
        out[doc] = runs_by_word(own[doc], min_length, times)
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """The words that remain if of every run only its first period stays."""
    step = np.zeros(n + 1, np.int64)
    for a, length, p in found:
        step[a + p] += 1
        step[a + length] -= 1
    return np.flatnonzero(np.cumsum(step[:-1]) == 0)


def planting(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """First word and period of the repeats that are put into a document of n words, if any."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents, by doc_id, all words from some word on repeat a stretch of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own = (text or b"").split() if doc_id is not None and not zlib.crc32(str(doc_id).encode()) % 10 else []
                put = planting(doc_id, len(own))
                if put is not None:
                    a, p = put
                    turn = own[a : a + p]
                    text = b" ".join(own[:a] + (turn * -(-(len(own) - a) // p))[: len(own) - a])
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("text", T.StringType())]))


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def detect(docs: DataFrame, min_length: int = MIN_LENGTH, times: int = MIN_TIMES) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed: the text's words, joined by spaces, of each run only the first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column("text"))
            own = [(t or b"").split() for t in b.column("text").cast(pa.binary()).to_pylist()]
            found = runs(own, w.hash, min_length, times)
            rest = [b" ".join([words[i] for i in kept(len(words), r)] if r else words) for words, r in zip(own, found, strict=True)]
            size = np.cumsum([0, *map(len, found)])
            flat = np.array([x for r in found for x in r], np.int64).reshape(-1, 3)
            spans = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(w.count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(size, pa.int32()), spans), pa.array(rest, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"]
            )

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(f"n_words long, runs array<{RUN}>, collapsed string")])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def longest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run and digests of all runs and of the collapsed text, of the rows of detect()."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    told = found.withColumn("_best", best)
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

"""Quality rules: rule statistics of whole texts, judged by an isolation forest.

Each document gets the statistics that heuristic filters use. Two of them decide
by themselves (too few words, too much repetition). The others go to an isolation
forest: trees of random splits, grown on well-rated labelled rows, in which a
document unlike these is separated after few splits. Its mean path length alone is
the anomaly score, and labelled rows give the score beyond which documents are
rejected: nothing but the base rule and the forest rejects.

Every labelled row counts, however many there are: the ranges of the features and
the threshold are exact quantiles over all of them, and each tree counts all
well-rated rows in its nodes, where they weigh as much as SUBSAMPLE rows would.

Defined results: a null or empty text has no words and fails the base rule. Very
long texts are read whole, one at a time. Repeated rows and repeated doc_ids are
judged row by row. An empty table gives no rows. Without labelled rows, or without
badly rated ones, only the base rule rejects. Labels with a null doc_id or quality
are ignored; of several labels of one document the lowest holds. Extra columns of
documents, of any name, are ignored by assess() and kept by keep_good().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm.ordered import cut, quantiles, small_batches
from loomgrid.llm.words import BASE, Words, mix, ranges, slices

MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
TREES, SUBSAMPLE, DEPTH, SEED = 128, 256, 14, 17
#: Levels that trees grow between two counts of the rows in their nodes, and rows that descend at a time.
ROUNDS, ROWS = (5, 3, 3, 3), 2_000
#: A part of a tree with at most this weight of rows is a leaf.
LEAST = 0.25
#: Share of normal rows beyond either end of a feature's range, and how far splits reach, in half ranges.
RANGE, REACH = 0.001, 3.0
#: Share of well-rated labelled rows that calibration may lose.
LOSS = 0.002

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "uppercase", "marks", "digits", "other", "top_bigram", "line_words", "novelty"]

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), range(65, 91))
_MARK = np.isin(np.arange(256), list(b"!?;:"))
_DIGIT = np.isin(np.arange(256), range(48, 58))
_OTHER = np.isin(np.arange(256), [x for x in range(33, 128) if not chr(x).isalnum() and chr(x) not in "#*$%&|<>!?;:.,'\"-()"])


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    return np.isin(keys, twice, assume_unique=False) if len(twice) else np.zeros(len(keys), bool)


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts and the feature matrix of whole texts."""
    w = Words(texts)
    n, salt = w.n, mix(np.arange(w.n).astype(np.uint64) + np.uint64(1))
    lead = (w.data & 0xC0) != 0x80
    chars = w.totals(lead & w.inside)
    out = {"n_words": w.count, "word_chars": chars, "n_symbols": w.totals(_SYMBOLS[w.data])}

    cut = np.flatnonzero(w.data == 10)
    lo = np.sort(np.concatenate([w.at[:-1], cut + 1]))
    hi = np.sort(np.concatenate([cut, w.at[1:]]))
    owner = np.searchsorted(w.at[1:], lo, side="right")
    # a text that ends in a line break has an empty last line, which may start where the next text does
    worded = np.searchsorted(w.lo, hi) > np.searchsorted(w.lo, lo)
    lo, hi, owner = lo[worded], hi[worded], owner[worded]
    lines = np.bincount(owner, minlength=n)
    keys = ranges(w.sums, lo, hi, BASE) ^ salt[owner]
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order][1:] == keys[order][:-1]
    out["n_dup_lines"] = np.bincount(owner[again], minlength=n)

    at = w.starts(REPEAT_WINDOW)
    twice = at[_repeated(w.windows(REPEAT_WINDOW, at) ^ salt[w.doc[at]])] if len(at) else at
    step = np.zeros(len(w.lo) + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = np.bincount(w.doc[np.cumsum(step[:-1]) > 0], minlength=n)

    pair = w.starts(2)
    top, fresh = np.zeros(n), np.zeros(n)
    if len(pair):
        keys, owner = w.windows(2, pair) ^ salt[w.doc[pair]], w.doc[pair]
        order = np.argsort(keys, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        size = np.diff(np.append(new, len(keys)))
        np.maximum.at(top, owner[order[new]], size.astype(float))
    single = w.hash ^ salt[w.doc]
    if len(single):
        order = np.argsort(single, kind="stable")
        new = order[np.concatenate([[True], single[order][1:] != single[order][:-1]])]
        fresh = np.bincount(w.doc[new], minlength=n)
    words, glyphs = np.maximum(w.count, 1), np.maximum(chars, 1)
    features = np.stack(
        [
            np.log1p(w.count), chars / words, out["n_symbols"] / words, out["n_dup_lines"] / np.maximum(lines, 1), out["n_repeat_words"] / words,
            w.totals(_UPPER[w.data]) / glyphs, w.totals(_MARK[w.data]) / words, w.totals(_DIGIT[w.data]) / glyphs, w.totals(_OTHER[w.data]) / words,
            top / words, np.log1p(w.count / np.maximum(lines, 1)), np.log1p(fresh) / np.log1p(words),
        ],
        axis=1,
    )
    return {k: v.astype(np.int64) for k, v in out.items()}, features


def _expected(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a random tree of n points; n need not be whole."""
    n = np.maximum(n, 1.0)
    return np.maximum(2 * (np.log(n - 0.5) + np.euler_gamma) - 2 * (n - 1) / n, 0.0)


class Forest:
    """Isolation trees in arrays: split feature and value, first of two children, path length at leaves.

    points: the rows that count as normal. Features are put on the scale of their
    range among these, from -1 to 1, and cut off at REACH. Splits are random in the
    whole box up to there, also where no normal row lies; a part without normal rows
    is a leaf at once, so that rows unlike all normal ones end on short paths.

    As splits do not depend on the rows, a tree is not grown on a drawn subsample:
    it counts all rows, each at the weight at which they make up one, and a part with
    a weight of at most LEAST is a leaf. So a tree's size does not grow with the rows.
    """

    def __init__(self, points: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        def count(forest: Forest) -> np.ndarray:
            return np.bincount(forest.leaves(points).ravel(), minlength=len(forest.feature))

        self.grow(np.quantile(points, RANGE, axis=0), np.quantile(points, 1 - RANGE, axis=0), len(points), count, trees, subsample, seed)

    @classmethod
    def over(cls, rows: DataFrame) -> Forest:
        """The forest of the rows of a table, by column x: the same as of all of them in one array."""
        named = F.explode(F.expr("transform(x, (v, i) -> struct(cast(i as string) as feature, v as value))")).alias("f")
        ends = quantiles(rows.select(named).select("f.*"), "feature", "value", lambda _, n: [RANGE * (n - 1), (1 - RANGE) * (n - 1)])
        low, high = (np.array([ends[str(k)][i] for k in range(len(FEATURES))]) for i in (0, 1))

        def count(forest: Forest) -> np.ndarray:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = np.zeros(len(forest.feature), np.int64)
                for b in batches:
                    x = _matrix(b)
                    for i in range(0, len(x), ROWS):
                        out += np.bincount(forest.leaves(x[i : i + ROWS]).ravel(), minlength=len(out))
                met = np.flatnonzero(out)
                yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(out[met])], names=["node", "n"])

            got = rows.select("x").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).toArrow()
            out = np.zeros(len(forest.feature), np.int64)
            out[got.column("node").to_numpy()] = got.column("n").to_numpy()
            return out

        forest = cls.__new__(cls)
        forest.grow(low, high, rows.count(), count)
        return forest

    def grow(self, low: np.ndarray, high: np.ndarray, n: int, count: Callable[[Forest], np.ndarray], trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> None:
        """low, high: the range of each feature among n rows; count: how many of these end in each node of the trees so far."""
        rng = np.random.default_rng(seed)
        self.middle, self.half = (low + high) / 2, np.maximum((high - low) / 2, 5e-4)
        self.steps, self.norm, self.roots = 0, float(DEPTH), np.arange(trees, dtype=np.int32)
        self.feature, self.value, self.child, self.path = np.full(trees, -1, np.int16), np.zeros(trees), np.zeros(trees, np.int32), np.zeros(trees)
        weight = min(1.0, max(2, min(subsample, n // 2)) / max(n, 1))
        last, lo, hi = self.roots if n > 1 else self.roots[:0], np.full((trees, len(low)), -REACH), np.full((trees, len(low)), REACH)
        for levels in ROUNDS:
            if not len(last):
                break
            grown = [last]
            for _ in range(levels):
                own, rows = grown[-1], np.arange(len(grown[-1]))
                f = rng.integers(0, len(low), len(own))
                v = rng.uniform(lo[rows, f], hi[rows, f])
                self.feature[own], self.value[own], self.child[own] = f, v, len(self.feature) + 2 * rows
                lo, hi = np.repeat(lo, 2, axis=0), np.repeat(hi, 2, axis=0)
                hi[2 * rows, f] = lo[2 * rows + 1, f] = v
                more = 2 * len(own)
                grown.append(np.arange(len(self.feature), len(self.feature) + more, dtype=np.int32))
                self.feature, self.value = np.append(self.feature, np.full(more, -1, np.int16)), np.append(self.value, np.zeros(more))
                self.child, self.path = np.append(self.child, np.zeros(more, np.int32)), np.append(self.path, np.zeros(more))
            self.steps += levels
            mass = weight * count(self)
            for own in reversed(grown[:-1]):
                mass[own] = mass[self.child[own]] + mass[self.child[own] + 1]
            # what lies below a leaf goes
            kept = np.ones(len(self.feature), bool)
            for d, own in enumerate(grown, self.steps - levels):
                closed = (mass[own] <= LEAST + 1e-9) | (d == self.steps)
                # in whole parts of 2 ** -16, so that sums do not depend on their order
                self.path[own] = np.where(closed, np.round((d + _expected(mass[own])) * 65536) / 65536, 0.0)
                if d < self.steps:
                    both = np.stack([self.child[own], self.child[own] + 1])
                    kept[both] = kept[own] & ~closed
                    self.feature[own[closed]] = -1
            going = kept[grown[-1]] & (mass[grown[-1]] > LEAST + 1e-9)
            place = (np.cumsum(kept) - 1).astype(np.int32)
            last, lo, hi = place[grown[-1][going]], lo[going], hi[going]
            self.child = np.where(self.feature >= 0, place[self.child], 0)[kept].astype(np.int32)
            self.feature, self.value, self.path = self.feature[kept], self.value[kept], self.path[kept]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node of each tree (first axis) in which each row ends."""
        x, rows = ((x - self.middle) / self.half).clip(-REACH, REACH), np.arange(len(x))[None]
        at = np.repeat(self.roots[:, None], len(x), 1)
        for _ in range(self.steps):
            f = self.feature[at]
            at = np.where(f < 0, at, self.child[at] + (x[rows, np.maximum(f, 0)] >= self.value[at]))
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores from 0 to 1, by mean path length; higher is odder."""
        out = [2.0 ** (-self.path[self.leaves(x[i : i + ROWS])].mean(0) / self.norm) for i in range(0, len(x), ROWS)]
        return np.concatenate(out) if out else np.zeros(0)


def calibrated(scored: DataFrame, loss: float = LOSS) -> float:
    """A threshold above which at most this share of good rows lies; none without both kinds. scored: good and score of all labelled rows.

    Where badly rated rows leave a gap above that, it lies three quarters up the gap
    below 99 % of them, on the side that keeps documents.
    """
    named = scored.select(F.col("good").cast("string").alias("good"), "score")
    ends = quantiles(named, "good", "score", lambda _, n: [min(n - 1, int(np.ceil((1 - loss) * n)) - 1)])
    if set(ends) != {"true", "false"}:
        return float("inf")
    (least,) = ends["true"]
    bad = quantiles(named.filter(~F.col("good").cast("boolean") & (F.col("score") > least)), "good", "score", lambda _, n: [0.01 * (n - 1)])
    return least + 0.75 * (bad["false"][0] - least) if bad else least


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"])


class Judge:
    """A forest of well-rated rows in a box around all labelled ones, and the score beyond which documents go."""

    def __init__(self, forest: Forest | None = None, threshold: float = float("inf")):
        self.forest, self.threshold = forest, threshold

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.forest is None else self.forest.score(x)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and x, the features, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts, x = statistics(b.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(counts[c]) for c in COUNTS), pa.array(base_failed(counts)), lists], names=["doc_id", *COUNTS, "base_failed", "x"])

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def fit_judge(rows: DataFrame, labels: DataFrame) -> Judge:
    """Grown and calibrated on all labelled rows that pass the base rule; rows: as measured() gives them."""
    rated = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    rows = cut(rows.filter("not base_failed").select("doc_id", "x").join(rated, "doc_id").select("good", "x"))
    good = rows.filter("good")
    if good.isEmpty():
        return Judge()
    judge = Judge(Forest.over(good))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("good"), pa.array(judge.score(_matrix(b)))], names=["good", "score"])

    return Judge(judge.forest, calibrated(cut(rows.mapInArrow(run, "good boolean, score double"))))


RESULT = [*((c, T.LongType()) for c in COUNTS), ("base_failed", T.BooleanType()), ("anomaly", T.DoubleType()), ("kept", T.BooleanType())]


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, the anomaly score, and whether the document is kept."""
    rows = cut(measured(docs))
    judge = fit_judge(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, bad = judge.score(_matrix(b)), b.column("base_failed").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score), pa.array(~bad & (score <= judge.threshold))], names=["doc_id", *(c for c, _ in RESULT)])

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, t) for c, t in RESULT)])
    return rows.select("doc_id", *COUNTS, "base_failed", "x").mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that are kept, with all their columns."""
    judge = fit_judge(measured(docs), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts, x = statistics(b.column("text"))
            yield b.filter(pa.array(~base_failed(counts) & (judge.score(x) <= judge.threshold)))

    return docs.mapInArrow(run, docs.schema)

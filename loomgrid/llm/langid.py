"""Language identification by interpolated Kneser-Ney character models.

For each language of the training rows, counts of character 4-grams over all of
them give a Kneser-Ney model: discounted counts at the highest order,
continuation counts below, interpolated down to the uniform. A text is lowered,
each run of other than letters becomes one space, and its cross-entropy under
each model is divided by its length; the lowest wins. The models lie in sorted
hash arrays, one for each order, with the log probability under each language.

All training rows with letters calibrate two numbers: the sharpness that turns
differences of cross-entropy into a score, and each language's highest plausible
cross-entropy, an exact quantile; a text above it is marked as rejected, beside its
best language.

The models are broadcast whole, in blocks of languages. A block has at most
MAX_CELLS grams times languages, or one language; of several blocks a task holds
one at a time, and asks each for all texts at hand before the next. A language's
model does not depend on its block.

Defined results: a null text, or one without a letter, is `und` with score 0; so
is every text if nothing could be learned. Equal cross-entropies go to the first
language by code point. Training rows with null text, lang or doc_id teach
nothing. Repeated rows count as often as they occur. An empty table gives no
rows. Very long texts are read whole, one at a time. Extra columns of any name are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm.ordered import cut, quantiles
from loomgrid.llm.words import mix, slices

ORDER, MAX_CELLS, REJECT = 4, 8_000_000, 0.002
SHARPNESS = [2.0**k for k in range(-1, 7)]
HELD_SLICES, HELD_CELLS = 64, 4_000_000
SPACE = 0x20
#: The surrogates and the private use area after them.
SPARE, SPARES = 0xD800, 0x2100
INDEX_BITS = 20
U = np.uint64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point the lower-case letter in 16 bits, or 0 for other than letters."""
    table = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = ord(x.lower()) if len(x.lower()) == 1 else c
            # code points that are no letters stand for those that do not fit: blocks of letters stay distinct
            table[c] = low if low < 0x10000 else SPARE + (low - 0x10000) % SPARES
    return table


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, one after another, each text padded by ORDER - 1 spaces; and where each text starts, with an end.

    A text without letters has none.
    """
    n, wide = len(texts), pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, n + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    data = texts.buffers()[2]
    raw = memoryview(data)[at[0] : at[-1]] if data is not None else b""
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])[at - at[0]]
    points = np.frombuffer(bytes(raw).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _letters()[points]
    letter = code > 0
    # of each run of others in a text keep the first; the pads stand for those at the start of a text
    first = np.ones(len(code), bool)
    first[1:] = letter[:-1]
    start = chars[:-1][chars[:-1] < len(code)]
    first[start] = False
    keep = letter | first
    sums = np.concatenate([[0], np.cumsum(keep)])[chars]
    some = np.concatenate([[0], np.cumsum(letter)])[chars]
    length = np.where(np.diff(some) > 0, np.diff(sums) + ORDER - 1, 0)
    where = np.concatenate([[0], np.cumsum(length)])
    out = np.full(where[-1], SPACE, np.uint16)
    owner = np.repeat(np.arange(n), np.diff(chars))
    keep &= (length > 0)[owner]
    kept = np.flatnonzero(keep)
    own = owner[kept]
    value = code[kept]
    out[where[own] + ORDER - 1 + np.arange(len(kept)) - np.searchsorted(own, np.arange(n))[own]] = np.where(value > 0, value, SPACE)
    return out, where


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The packed grams of all texts, 16 bits a symbol, and where each text's start, with an end."""
    s, where = symbols(texts)
    n = np.maximum(np.diff(where) - ORDER + 1, 0)
    if not len(s):
        return np.zeros(0, U), np.zeros(len(n) + 1, np.int64)
    wide = s.astype(U)
    m = len(s) - ORDER + 1
    packed = np.zeros(m, U)
    for k in range(ORDER):
        packed = (packed << U(16)) | wide[k : k + m]
    owner = np.repeat(np.arange(len(n)), np.diff(where))[:m]
    inside = np.arange(m) - where[owner] < n[owner]
    return packed[inside], np.concatenate([[0], np.cumsum(n)])


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, gram and count over all rows of text and lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merge(lang: str) -> None:
            g, c = (np.concatenate(x) for x in zip(*held[lang], strict=True))
            keys, back = np.unique(g, return_inverse=True)
            held[lang] = [(keys, np.bincount(back, weights=c).astype(np.int64))]

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in sorted(held):
                merge(lang)
                (g, c), = held[lang]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], names=["lang", "gram", "count"])
            held.clear()

        for b in slices(batches):
            g, at = grams(b.column("text"))
            code = b.column("lang").dictionary_encode()
            owner = np.repeat(code.indices.to_numpy(zero_copy_only=False), np.diff(at))
            for k, lang in enumerate(code.dictionary.to_pylist()):
                held.setdefault(lang, []).append(np.unique(g[owner == k], return_counts=True))
                if len(held[lang]) > 16:
                    merge(lang)
            if sum(len(x[0]) for own in held.values() for x in own) > 4_000_000:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "lang string, gram long, count long").groupBy("lang", "gram").agg(F.sum("count").alias("count"))


class Model:
    """Log probabilities of grams of each order under each language, in sorted hash arrays; alphabet: of more languages than these, if given."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray, alphabet: int | None = None):
        self.langs, n_lang = langs, len(langs)
        keys, index = np.unique(gram, return_inverse=True)
        level = np.zeros((len(keys), n_lang))
        level[index, lang] = count
        tables = [(keys, level)]
        for order in range(ORDER - 1, 0, -1):  # continuation counts: by how many symbols a gram is preceded
            keys, level = tables[-1]
            low, back = np.unique(keys & U((1 << (16 * order)) - 1), return_inverse=True)
            cont = np.zeros((len(low), n_lang))
            np.add.at(cont, back, level > 0)
            tables.append((low, cont))
        tables.reverse()
        alphabet = alphabet or len(tables[0][0]) + 1
        self.floor = np.full(n_lang, -np.log(alphabet))
        self.index, self.value, self.backoff = [], [], []
        prob = np.full((1, n_lang), 1.0 / alphabet)
        lower_keys = np.zeros(1, U)
        for order, (keys, level) in enumerate(tables, 1):
            ones, twos = (level == 1).sum(0), (level == 2).sum(0)
            discount = np.where(ones + twos > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5).clip(0.1, 0.9)
            context, back = np.unique(keys >> U(16), return_inverse=True)
            total, kinds = np.zeros((len(context), n_lang)), np.zeros((len(context), n_lang))
            np.add.at(total, back, level)
            np.add.at(kinds, back, level > 0)
            gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            below = prob[np.searchsorted(lower_keys, keys & U((1 << (16 * (order - 1))) - 1))] if order > 1 else prob
            prob = np.maximum(level - discount, 0) / np.maximum(total, 1)[back] + gamma[back] * below
            lower_keys = keys
            self._add(keys, prob, context, gamma)

    def _add(self, keys, prob, context, gamma) -> None:
        def table(k, v):
            h = mix(k + U(1))
            order = np.argsort(h)
            h = h[order]
            return h, np.searchsorted(h >> U(64 - INDEX_BITS), np.arange((1 << INDEX_BITS) + 1, dtype=U)).astype(np.int32), np.log(v[order]).astype(np.float32)

        self.value.append(table(keys, prob))
        self.backoff.append(table(context, gamma))

    @staticmethod
    def find(table, keys: np.ndarray) -> np.ndarray:
        """Where the keys lie in a table, or -1: buckets by the leading bits, then steps through the bucket."""
        hashes, index, _ = table
        h = mix(keys + U(1))
        b = (h >> U(64 - INDEX_BITS)).astype(np.int64)
        at, end = index[b].astype(np.int64), index[b + 1]
        out = np.full(len(h), -1)
        todo = np.flatnonzero(at < end)
        at = at[todo]
        while len(todo):
            hit = hashes[at] == h[todo]
            out[todo[hit]] = at[hit]
            at += 1
            more = ~hit & (at < end[todo])
            todo, at = todo[more], at[more]
        return out

    def log_probs(self, packed: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order == 0:
            return np.broadcast_to(self.floor, (len(packed), len(self.floor))).astype(np.float32)
        at = self.find(self.value[order - 1], packed)
        out = self.value[order - 1][2][at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            own = packed[miss]
            con = self.find(self.backoff[order - 1], own >> U(16))
            gamma = self.backoff[order - 1][2][con]
            gamma[con < 0] = 0
            out[miss] = gamma + self.log_probs(own & U((1 << (16 * (order - 1))) - 1), order - 1)
        return out

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a symbol of each text under each language, and its number of symbols."""
        g, at = grams(texts)
        n = np.diff(at)
        out = np.zeros((len(n), len(self.langs)))
        some = np.flatnonzero(n)
        if len(some):
            out[some] = -np.add.reduceat(self.log_probs(g).astype(np.float64), at[some], axis=0) / n[some][:, None]
        return out, n


class Identifier:
    """The models of all languages in broadcast blocks, and what the training rows calibrate."""

    def __init__(self, langs: list[str], blocks: list[Broadcast]):
        self.langs, self.blocks = langs, blocks
        self.sharpness, self.highest = 1.0, np.full(len(langs), np.inf)

    def _entropies(self, texts: list[pa.Array]) -> list[tuple[np.ndarray, np.ndarray]]:
        found: list[list] = [[] for _ in texts]
        for block in self.blocks:
            model = block.value
            for own, t in zip(found, texts, strict=True):
                own.append(model.entropies(t))
            del model
            if len(self.blocks) > 1 and hasattr(block, "_path"):
                block.__dict__.pop("_value", None)  # it is read from disk when next asked for
        return [(np.concatenate([e for e, _ in own], axis=1), own[0][1]) if own else (np.zeros((len(t), 0)), np.zeros(len(t), np.int64)) for own, t in zip(found, texts, strict=True)]

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Slices of the batches, each text's cross-entropy a symbol under each language, and its number of symbols."""
        held: list[pa.RecordBatch] = []
        for b in slices(batches):
            held.append(b)
            if len(self.blocks) < 2 or len(held) == HELD_SLICES or sum(x.num_rows for x in held) * len(self.langs) >= HELD_CELLS:
                for x, (e, n) in zip(held, self._entropies([x.column("text") for x in held]), strict=True):
                    yield x, e, n
                held = []
        for x, (e, n) in zip(held, self._entropies([x.column("text") for x in held]), strict=True):
            yield x, e, n

    def best(self, e: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected."""
        if not self.langs:
            return ["und"] * len(n), np.zeros(len(n)), np.ones(len(n), bool)
        pick = e.argmin(1)
        low = e.min(1)
        score = 1.0 / np.exp(-self.sharpness * (e - low[:, None])).sum(1)
        return [self.langs[k] if m else "und" for k, m in zip(pick, n, strict=True)], np.where(n > 0, score, 0.0), (n == 0) | (low > self.highest[pick])

    def calibrate(self, rows: DataFrame) -> None:
        """By all rows of text and lang that have letters."""
        place = {x: k for k, x in enumerate(self.langs)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, e, n in self.scored(batches):
                some = np.flatnonzero(n)
                e, lang = e[some], b.column("lang").take(pa.array(some))
                at = np.arange(len(some)), np.array([place[x] for x in lang.to_pylist()], np.int64)
                gap = e - e.min(1, initial=np.inf)[:, None]
                fits = [-t * gap[at] - np.log(np.exp(-t * gap).sum(1)) for t in SHARPNESS]
                yield pa.RecordBatch.from_arrays([lang, pa.array(e[at]), *map(pa.array, fits)], names=["lang", "own", *names])

        names = [f"fit{k}" for k in range(len(SHARPNESS))]
        scored = cut(rows.select("text", "lang").mapInArrow(run, T.StructType([T.StructField("lang", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("own", *names))])))
        fit = scored.agg(*(F.avg(c).alias(c) for c in names)).first()
        if fit[names[0]] is None:
            return
        self.sharpness = SHARPNESS[max(range(len(names)), key=lambda k: fit[names[k]])]
        for lang, (x,) in quantiles(scored, "lang", "own", lambda _, n: [(1 - REJECT) * (n - 1)]).items():
            self.highest[place[lang]] = x


def blocks_of(sizes: list[int], max_cells: int) -> list[list[int]]:
    """Successive languages in blocks of at most max_cells grams times languages, or of one language; sizes: grams of each."""
    out: list[list[int]] = []
    total = 0
    for k, n in enumerate(sizes):
        if out and (total + n) * (len(out[-1]) + 1) <= max_cells:
            out[-1].append(k)
            total += n
        else:
            out.append([k])
            total = n
    return out


def train(docs: DataFrame, max_cells: int = MAX_CELLS) -> Identifier:
    """Learns from every row of text and lang, and calibrates on every one."""
    rows = docs.filter("text is not null and lang is not null and doc_id is not null")
    counts = cut(gram_counts(rows.select("text", "lang")))
    sizes = [(r["lang"], r["count"]) for r in counts.groupBy("lang").count().orderBy("lang").collect()]
    langs = [lang for lang, _ in sizes]
    if not langs:
        return Identifier([], [])
    alphabet = counts.select(F.expr("gram & 65535L")).distinct().count() + 1
    blocks = []
    for block in blocks_of([n for _, n in sizes], max_cells):
        own = [langs[k] for k in block]
        got = counts.filter(F.col("lang").isin(own)).toArrow()
        code = got.column("lang").combine_chunks().dictionary_encode()
        place = np.array([own.index(x) for x in code.dictionary.to_pylist()])
        model = Model(own, place[code.indices.to_numpy()], got.column("gram").to_numpy().view(U), got.column("count").to_numpy().astype(float), alphabet)
        blocks.append(docs.sparkSession.sparkContext.broadcast(model))
        del got, code, model
    models = Identifier(langs, blocks)
    models.calibrate(rows)
    return models


def identify(docs: DataFrame, models: Identifier) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, e, n in models.scored(batches):
            lang, score, rejected = models.best(e, n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))

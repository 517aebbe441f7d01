"""Source divergence audit: how far the term frequencies of sources lie apart.

Documents belong to groups of one language and source. A language keeps the terms
that at least MIN_DOCS of its documents hold. Each kept term has in each group, and
in the language as a whole, a smoothed frequency in parts of UNIT, an integer; all
sums are exact.

Pairs of groups are compared by tiles in two dimensions: the groups of a language
are cut into blocks of BLOCK, its kept terms into chunks of CHUNK, and a group's
counts of one chunk are packed into one row. Each row goes to the tiles of its own
block with every block, so a tile (block, block) holds all that its pairs need. It
reads its chunks one after another and adds each chunk's differences to a matrix of
BLOCK x BLOCK sums, which bounds its memory whatever the vocabulary. A tile takes
STRETCH chunks; a larger vocabulary has more tiles, whose exact sums are added up.

Terms are counted where they are read, in a table of at most HELD entries a task,
which is passed on and begun anew when it is full: a group with a third of all rows
sends as many rows to a shuffle as it has terms, not words.

Defined results: a null text, lang or source is ''. A group without kept terms is a
group with counts of 0; a language without any has differences of 0 and no terms. A
group alone in its language has no pairs. Repeated rows count each. Very long texts
are read whole. An empty table gives no rows. Extra columns are ignored. Sums hold
while a language has less than 9 * 10**15 occurrences of kept terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.ordered import cut, parts, ranked
from loomgrid.llm.words import slices

MIN_DOCS, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Groups of a block, terms of a chunk, chunks of a tile.
BLOCK, CHUNK, STRETCH = 32, 2048, 8
#: Terms that a task counts before it passes its counts on.
HELD = 400_000

#: Bytes to lower-case letters; all that is no part of a term to a space.
_FOLD = bytes(x | 0x20 if 0x41 <= x <= 0x5A else x if 0x61 <= x <= 0x7A or x >= 0x80 else 0x20 for x in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order: runs of letters and of code points beyond ASCII, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs: occurrences and documents of each term of each group; a group's own row has the term ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def passed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in found.items():
                keys = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array([source] * len(keys)), pa.array(keys, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[k] for k in keys], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
            found.clear()

        for b in slices(batches):
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own, seen = found[lang, source]
                words = terms(text)
                own.update(words)
                own[b""] += 0
                seen.update(set(words))
            if sum(len(n) for n, _ in found.values()) > HELD:
                yield from passed()
        yield from passed()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * kept)), three digits at a time, so that no product overflows."""
    whole, out, left = total + SMOOTH * kept, F.lit(1).cast("long"), count + SMOOTH
    for digit in (1_000_000, 1_000, 1):
        left = left * 1000
        out = out + F.call_function("div", left, whole) * digit
        left = left % whole
    return out


def shares(count: np.ndarray, whole: int) -> np.ndarray:
    """share() of an array of counts."""
    left, out = count + SMOOTH, np.ones(count.shape, np.int64)
    for digit in (1_000_000, 1_000, 1):
        left = left * 1000
        out += left // whole * digit
        left %= whole
    return out


def vocabulary(counted: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, lang_n, place, kept and total of each kept term: its occurrences in the language, its place from 0, their number and all their occurrences."""
    found = counted.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    return ranked(found.select("lang", "term", "lang_n"), "lang", ["term"], ["lang_n"]).select("lang", "term", "lang_n", F.col("rank").alias("place"), F.col("group_rows").alias("kept"), F.col("all_lang_n").alias("total"))


def _tiles(batches: Iterator[pa.RecordBatch], block: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """lang, source, item and value of each pair of groups of each tile, from its rows in order of tile and chunk; chunk -1 are the groups."""
    tile, groups, at, rows, sums, width = None, [], -1, [], None, 0

    def begun() -> None:
        nonlocal sums
        left, right = ([g for g in groups if g[side]] for side in ("left", "right"))
        for own in (left, right):
            for i, g in enumerate(own):
                g["at"] = (*g.get("at", ()), (own is right, i))
        sums = (left, right, np.zeros((len(left), len(right)), np.int64))

    def zero(own: list[dict], n: int) -> np.ndarray:
        return np.repeat(np.array([shares(np.zeros(1, np.int64), g["whole"])[0] for g in own], np.int64)[:, None], n, axis=1)

    def added() -> None:
        """Adds the chunk's differences, or those of all chunks that no group has counts in."""
        nonlocal width
        left, right, matrix = sums
        n = min(chunk, groups[0]["kept"] - at * chunk)
        a, b = zero(left, n), zero(right, n)
        sides, by = (a, b), {g["place"]: g for g in groups}
        for place, slots, counted in rows:
            g = by[place]
            p = shares(counted, g["whole"])
            for side, i in g["at"]:
                sides[side][i, slots] = p
        for i in range(len(left)):
            matrix[i] += np.abs(b - a[i]).sum(axis=1)
        width -= n

    def ended() -> Iterator[pa.RecordBatch]:
        if sums is None:
            begun()
        if rows:
            added()
        left, right, matrix = sums
        if width > 0:
            matrix += width * np.abs(zero(left, 1) - zero(right, 1).T)
        # each pair once: the first of both has the lower place
        i, j = np.nonzero(np.array([g["place"] for g in left])[:, None] < np.array([g["place"] for g in right])[None, :])
        if len(i):
            names = [pa.array([own[k]["source"] for k in index]) for own, index in ((left, i), (right, j))]
            yield pa.RecordBatch.from_arrays([pa.array([tile[0]] * len(i)), *names, pa.array(matrix[i, j])], names=["lang", "source", "item", "value"])

    for batch in batches:
        for r in zip(*(batch.column(c) if c in ("slots", "counted") else batch.column(c).to_pylist() for c in ("lang", "a", "b", "stretch", "chunk", "place", "mine", "source", "total", "kept", "slots", "counted")), strict=True):
            own, k = r[:4], r[4]
            if own != tile:
                if tile is not None:
                    yield from ended()
                tile, groups, at, rows, sums = own, [], -1, [], None
                width = max(0, min(r[9], (r[3] + 1) * STRETCH * chunk) - r[3] * STRETCH * chunk)
            if k < 0:
                groups.append({"place": r[5], "left": r[6] == own[1], "right": r[6] == own[2], "source": r[7], "whole": max(1, r[8] + SMOOTH * r[9]), "kept": r[9]})
                continue
            if sums is None:
                begun()
            if k != at and rows:
                added()
                rows = []
            at = k
            rows.append((r[5], r[10].values.to_numpy(), r[11].values.to_numpy()))
    if tile is not None:
        yield from ended()


def pairs(held: DataFrame, groups: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """lang, source, item and value of all ordered pairs of groups of a language.

    held: lang, source, place_in_lang, place and n of each term of each group; groups: lang, source, place_in_lang, groups, total and kept.
    """
    mine, blocks = F.expr(f"place_in_lang div {block}"), F.expr(f"(groups - 1) div {block}")
    packed = held.groupBy("lang", "place_in_lang", "groups", F.expr(f"place div {chunk}").alias("chunk")).agg(F.collect_list(F.struct((F.col("place") % chunk).cast("int").alias("slot"), "n")).alias("own"))
    stretches = F.expr(f"greatest((kept - 1) div {chunk * STRETCH}, 0L)")
    heads = groups.select("lang", "place_in_lang", "groups", F.explode(F.sequence(F.lit(0).cast("long"), stretches)).alias("stretch"), F.lit(-1).cast("long").alias("chunk"), "source", "total", "kept", F.array().cast("array<int>").alias("slots"), F.array().cast("array<bigint>").alias("counted"))
    body = packed.select("lang", "place_in_lang", "groups", F.expr(f"chunk div {STRETCH}").alias("stretch"), "chunk", F.lit("").alias("source"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("kept"), F.col("own.slot").alias("slots"), F.col("own.n").alias("counted"))
    rows = heads.unionByName(body).filter("groups > 1").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks)))
    tiles = rows.select("lang", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "stretch", "chunk", F.col("place_in_lang").alias("place"), "mine", "source", "total", "kept", "slots", "counted")
    tile = ["lang", "a", "b", "stretch"]
    sorted_ = tiles.repartition(parts(tiles), *tile).sortWithinPartitions(*tile, "chunk", "place")
    once = sorted_.mapInArrow(lambda batches: _tiles(batches, block, chunk), "lang string, source string, item string, value long")
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return once.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", both.alias("_p"), "value").select("lang", "_p.source", "_p.item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """lang, source, part, item, value and rank: each group's other sources by difference, and the terms it uses most beyond its language."""
    counted = cut(counts(docs))
    kept = vocabulary(counted, min_docs)
    held = cut(counted.filter("term <> ''").select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.max("kept").alias("kept"))
    known = counted.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "kept"])
    groups = cut(ranked(known, "lang", ["source"]).select("lang", "source", "total", "kept", F.col("rank").alias("place_in_lang"), F.col("group_rows").alias("groups")))
    own = held.join(groups.select("lang", "source", F.col("total").alias("own_total"), "place_in_lang", "groups"), ["lang", "source"])
    far = pairs(own, groups, block, chunk).withColumn("part", F.lit("pair"))
    p, q = share(F.col("n"), F.col("own_total"), F.col("kept")), share(F.col("lang_n"), F.col("total"), F.col("kept"))
    more = own.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # a rank limit goes to the tasks before the shuffle: each sends no more than `top` rows a group
    terms_ = more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return far.withColumn("rank", F.row_number().over(order)).select(*out).unionByName(terms_.select(*out))

"""N-gram Jaccard join: all texts whose shingle sets are alike, as components.

Words are lowered in A-Z; a text's set holds its distinct shingles of k words, or
its whole word sequence if it is shorter. Two texts link when percent * union <=
100 * intersection. The join is size-aware. A light set, of at most `bound`
shingles, lists all its subsets of each size that a link with another light set
needs; equal subsets are links at once. Heavy sets, and light ones that can link
with them, go through inverted lists, in steps that each lose no link:

1.  Shingles have one global order: those met often in a stretch of the corpus
    last, by how often, the others first, by hash. A set that links lacks at most m
    of its shingles in its partner, so of the first 2 m + 1 of each some m + 1 are
    common to both. All sets send these, packed by ranges of hashes, to be compared;
    a set too few of whose first shingles are in any other's is done. For most texts
    that is so, and nothing else of them is ever moved.
2.  Of the sets that are left a second scan reads all shingles. Their first m + 1 go
    to inverted lists, with their places in the order, which bound what two sets can
    have in common from where they meet. Short lists propose all pairs that sizes and
    places allow, long ones stars: leaders with all others. Each set has a bitmap of
    the parities of its shingles, four to eight bits a shingle: the bits in which
    two bitmaps differ are no more than the shingles in which the sets differ. Pairs
    that pass are verified exactly, and components formed. Near copies, however many,
    are mostly one component by now.
3.  Long lists that still hold several components propose pairs between these,
    block by block, first, twice, a forest of the most alike pairs that would join
    them, then, after these are verified, all others. Bitmaps come first, then
    verification.

The bound is where the rows of listing subsets begin to outnumber those of lists,
by the sizes of all sets. Equal sets are one from the start. The order changes
costs alone: any order gives the same links.

Defined results: null, empty and blank texts have no shingles, link with nothing
and are their own component. Repeated rows are equal sets; a null doc_id takes
part, and names a component only if no other can. An empty table gives no rows.
Very long texts are read whole, one at a time. Extra columns of any name are
ignored by join() and kept by distinct_texts().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm.components import components
from loomgrid.llm.ordered import cut, parts, small_batches
from loomgrid.llm.words import Words, mix, slices

U = np.uint64
#: Lists of at most SHORT members propose all pairs; longer ones LEADERS stars a block of at most BLOCK members.
SHORT, BLOCK, LEADERS = 8, 1024, 8
#: Shingles that STRETCH successive ones hold in OFTEN sets come last; at most MAX_OFTEN of them are told apart. A list of more than SPLIT sets is dealt to several tasks.
STRETCH, OFTEN, MAX_OFTEN, SPLIT = 1 << 21, 4, 1 << 20, 4096
#: Shingles that a task packs at once, and that one bucket of them is to hold.
HELD, BUCKET = 1 << 19, 1 << 19
#: Sets of at most so many shingles are carried along by the first scan, so that the light ones need no other; no cost-chosen boundary comes near.
CARRIED = 64
#: Bits of the filter of the second scan for each set it looks for, and at most.
FILTER_RATE, MAX_FILTER_BITS = 16, 29


class Rule:
    """What sets of given sizes need to link."""

    def __init__(self, percent: int):
        self.percent = percent

    def overlap(self, s, t):
        """The least intersection of sets of s and t that links them."""
        return -(-self.percent * (s + t) // (100 + self.percent))

    def sent(self, s):
        """How many first shingles of a set are sent: one more than a partner may lack, as the intersection is at least percent of either set."""
        return s - -(-s * self.percent // 100) + 1

    def front(self, s):
        """How many first shingles of a set are compared: what a partner may lack, and once more."""
        return np.minimum(s, 2 * self.sent(s) - 1)

    def met(self, s):
        """How many of its first shingles a set that links has in common with its partner's, if that is as small as can be."""
        t = -(-s * self.percent // 100)
        return self.front(t) - self.sent(t) + 1

    def subsets(self, s: int, bound: int) -> list[tuple[int, int]]:
        """Sizes of light partners and the overlap each needs."""
        return [(t, self.overlap(s, t)) for t in range(-(-s * self.percent // 100), min(bound, s * 100 // self.percent) + 1) if self.overlap(s, t) <= min(s, t)]


def elements(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and shingle of each distinct shingle, by hash within a document, and the sizes of the sets."""
    w = Words(texts, lower=True)
    doc, _, e = w.shingles(k)
    ends = np.searchsorted(doc, np.arange(w.n + 1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        e[a:b].sort()
    new = np.ones(len(e), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (e[1:] != e[:-1])
    if not new.all():
        doc, e = doc[new], e[new]
    return doc, e, np.bincount(doc, minlength=w.n)


def identities(e: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One number for each set: the sum of its mixed shingles."""
    sums = np.zeros(len(e) + 1, U)
    np.cumsum(mix(e + U(1)), out=sums[1:])
    end = np.cumsum(size)
    return sums[end] - sums[end - size]


def _each(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices, set number and size of each row, which sets the task has not met before, and the shingles of those."""
    met: set[int] = set()
    for b in slices(batches):
        doc, e, size = elements(b.column("text"), k)
        own = identities(e, size)
        fresh = size > 0
        for i, x in enumerate(own.tolist()):
            if x in met:
                fresh[i] = False
            elif fresh[i]:
                met.add(x)
        keep = slice(None) if fresh.all() else fresh[doc]
        yield b, own, size, fresh, doc[keep], e[keep]


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int64, copy=False) if values.dtype != U else values.view(np.int64))


#: Texts without a word.
BLANK = r"(text is null or not rlike(text, '[^\\x20\\x09-\\x0D]'))"


def described(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, _text (a hash of it), set, n_shingles and few (the shingles, if at most CARRIED) of each row; set is null without shingles.

    More rows, of no document, hold shingles that a stretch of the corpus has often: n_shingles is minus how often, set the shingle.
    """
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("_text", "set", "n_shingles")), T.StructField("few", T.ArrayType(T.LongType()))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        kind = None

        def often() -> pa.RecordBatch:
            x, n = np.unique(np.concatenate(held), return_counts=True)
            x, n = x[n >= OFTEN], n[n >= OFTEN]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(len(x), kind), pa.nulls(len(x), pa.int64()), _longs(x), _longs(-n), pa.nulls(len(x), pa.list_(pa.int64()))], names=names)

        for b, own, size, fresh, doc, e in _each(batches, k):
            kind = b.schema.field("doc_id").type
            held.append(e)
            short = fresh & (size <= CARRIED)
            at = np.where(short, size, 0)
            few = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(at)]), pa.int32()), _longs(e[short[doc]]), mask=pa.array(~short))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_text"), pa.array(own.view(np.int64), mask=size == 0), _longs(size), few], names=names)
            if sum(map(len, held)) >= STRETCH:
                yield often()
        if held:
            yield often()

    return small_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("_text")).mapInArrow(run, schema)


class Often:
    """Shingles that come last, in a sorted array, each with a class by how often it is met."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.rank = np.ceil(2 * np.log2(np.maximum(self.counts, 2))).astype(np.uint8)
        self.some = np.zeros(1 << 22, bool)
        self.some[(self.keys >> U(42)).astype(np.int64)] = True

    def find(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the shingles are here, and where."""
        may = np.flatnonzero(self.some[(e >> U(42)).astype(np.int64)])
        if not len(may):
            return may, may
        at = np.minimum(np.searchsorted(self.keys, e[may]), len(self.keys) - 1)
        hit = self.keys[at] == e[may]
        return may[hit], at[hit]


def often_of(rows: DataFrame) -> Often:
    """The shingles met most often, at most MAX_OFTEN; rows: from described()."""
    got = rows.filter("n_shingles < 0").groupBy("set").agg((-F.sum("n_shingles")).alias("n")).orderBy(F.desc("n"), "set").limit(MAX_OFTEN).toArrow()
    return Often(got.column("set").to_numpy().astype(np.int64).view(U), got.column("n").to_numpy().astype(np.int64))


def _first(order: Often, many: np.ndarray, doc: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in its order, shingle, and place in `order` or -1, of the first shingles of each set; many: how many of each; e: by hash within a set."""
    hit, at = order.find(e)
    last = np.zeros(len(e), bool)
    last[hit] = True
    light = np.flatnonzero(~last)
    row = doc[light]
    pos = np.arange(len(light)) - np.searchsorted(row, np.arange(len(many)))[row]
    keep = pos < many[row]
    have = np.bincount(row, minlength=len(many))
    row, pos, x = row[keep], pos[keep], e[light[keep]]
    where = np.full(len(row), -1)
    need = (have < many)[doc[hit]]
    if need.any():  # sets with too few others
        hit, at = hit[need], at[need]
        turn = np.lexsort((e[hit], order.rank[at], doc[hit]))
        hit, at = hit[turn], at[turn]
        d = doc[hit]
        p = np.arange(len(hit)) - np.searchsorted(d, np.arange(len(many)))[d] + have[d]
        ok = p < many[d]
        row, pos, x, where = np.concatenate([row, d[ok]]), np.concatenate([pos, p[ok]]), np.concatenate([x, e[hit[ok]]]), np.concatenate([where, at[ok]])
    return row, pos, x, where


def fronts(docs: DataFrame, k: int, rule: Rule, bound: int, often: Often, buckets: int) -> DataFrame:
    """bucket and packed (shingles, then sets) of the first shingles of each set; and, with packed null, set and n: how many of a set's first shingles are among those met often."""
    least = -(-(bound + 1) * rule.percent // 100)
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, names = shared.value, ["bucket", "packed", "set", "n"]
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            x, own = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            turn = np.argsort(x)
            x, own = x[turn], own[turn]
            at = ((x >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
            edges = np.append(np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])), len(x)).tolist()
            blobs = [x[i:j].tobytes() + own[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(at[edges[:-1]].astype(np.int32)), pa.array(blobs, pa.binary()), pa.nulls(len(blobs), pa.int64()), pa.nulls(len(blobs), pa.int64())], names=names)

        for _, own, size, fresh, doc, e in _each(batches, k):
            row, _, x, at = _first(order, np.where(fresh & (size >= least), rule.front(size), 0), doc, e)
            known = np.bincount(row[at >= 0], minlength=len(own))
            some = np.flatnonzero(known)
            if len(some):
                # these are in other sets, as they are met often
                yield pa.RecordBatch.from_arrays([pa.array((own[some] & U(0xFFFF)).astype(np.int32)), pa.nulls(len(some), pa.binary()), _longs(own[some]), _longs(known[some])], names=names)
            if len(x):
                held.append((x[at < 0], own[row[at < 0]]))
            if sum(len(x) for x, _ in held) >= HELD:
                yield packed()
        if sum(len(x) for x, _ in held):
            yield packed()

    return docs.select("text").mapInArrow(run, "bucket int, packed binary, set long, n long")


def met_sets(docs: DataFrame, rows: DataFrame, k: int, rule: Rule, bound: int, often: Often) -> DataFrame:
    """The sets enough of whose first shingles are in other sets' for a link; rows: from described()."""
    total = rows.filter("n_shingles > 0").agg(F.sum("n_shingles")).first()[0] or 0
    buckets = min(1 << 30, max(parts(rows), 2 * (100 - rule.percent) * total // 100 // BUCKET + 1))
    sent = fronts(docs, k, rule, bound, often, buckets)
    dealt = sent.repartition(parts(sent), "bucket").sortWithinPartitions("bucket")

    targets = parts(sent)
    Tally = tuple[np.ndarray, np.ndarray, np.ndarray]

    def shared(blobs: list[bytes]) -> Tally:
        """Of each set how many of a bucket's shingles are in other sets too."""
        arrays = [np.frombuffer(x, U) for x in blobs]
        x, own = (np.concatenate([a.reshape(2, -1)[i] for a in arrays]) for i in (0, 1))
        turn = np.argsort(x, kind="stable")
        x, own = x[turn], own[turn]
        start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        many = np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start)
        keep = np.repeat(many, np.diff(np.append(start, len(x))))
        x, own = x[keep], own[keep]
        turn = np.lexsort((x, own))  # tasks that met a set send it each
        x, own = x[turn], own[turn]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (own[1:] != own[:-1])
        sets, n = np.unique(own[new], return_counts=True)
        return sets, n.astype(U), np.zeros(len(n), U)

    def summed(tallies: list[Tally]) -> Tally:
        sets, n, often = (np.concatenate(c) for c in zip(*tallies, strict=True))
        turn = np.argsort(sets, kind="stable")
        sets, n, often = sets[turn], n[turn], often[turn]
        start = np.flatnonzero(np.concatenate([[True], sets[1:] != sets[:-1]])) if len(sets) else np.zeros(0, np.int64)
        return sets[start], np.add.reduceat(n, start) if len(start) else n, np.maximum.reduceat(often, start) if len(start) else often

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        tallies: list[Tally] = []
        last = None

        def packed() -> pa.RecordBatch:
            found = summed(tallies)
            tallies.clear()
            to = ((found[0] >> U(32)) * U(targets) >> U(32)).astype(np.int64)
            edges = np.append(np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])), len(to)).tolist() if len(to) else [0]
            blobs = [b"".join(c[i:j].tobytes() for c in found) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(to[edges[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["target", "packed"])

        for b in batches:
            known = b.filter(b.column("packed").is_null())
            if known.num_rows:
                tallies.append((known.column("set").to_numpy().view(U), np.zeros(known.num_rows, U), known.column("n").to_numpy().view(U)))
            b = b.filter(b.column("packed").is_valid())
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("packed"), strict=True):
                if bucket != last and held:
                    tallies.append(shared(held))
                    held = []
                held.append(blob.as_py())
                last = bucket
            if sum(len(x) for x, _, _ in tallies) >= HELD:
                yield packed()
        if held:
            tallies.append(shared(held))
        if tallies:
            yield packed()

    def total_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Tally] = []
        last = None

        def told() -> pa.RecordBatch:
            sets, n, often = summed(held)
            return pa.RecordBatch.from_arrays([_longs(sets), _longs(n + often)], names=["set", "n"])

        for b in batches:
            for target, blob in zip(b.column("target").to_pylist(), b.column("packed"), strict=True):
                if target != last and held:
                    yield told()
                    held = []
                held.append(tuple(np.frombuffer(blob.as_py(), U).reshape(3, -1)))
                last = target
        if held:
            yield told()

    tallied = dealt.mapInArrow(count, "target int, packed binary")
    counts = tallied.repartition(targets, "target").sortWithinPartitions("target").mapInArrow(total_of, "set long, n long")
    sizes = rows.filter("set is not null and n_shingles > 0").groupBy("set").agg(F.max("n_shingles").alias("s"))
    least = f"(s * {rule.percent} + 99) div 100"
    spare = f"({least}) * {100 - rule.percent} div 100"  # what a partner of that size may lack
    return counts.join(sizes, "set").filter(f"n >= least({least}, 2 * ({spare}) + 1) - ({spare})").select("set")


def postings(sets: DataFrame) -> DataFrame:
    """key, part, wide, set, size and pos of the shingles that each set sends; pos: the place in its order; sets: from whole_sets()."""
    return sets.select("set", "size", F.posexplode("first").alias("pos", "_f")).select("_f.key", "_f.part", "_f.wide", "set", "size", "pos")


def subsets(sets: DataFrame, rule: Rule, bound: int) -> DataFrame:
    """key, set, size and even of each subset that a light set lists; key: of the subset and the two sizes of its use; even: these are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, few in zip(b.column("set").to_pylist(), b.column("few"), strict=True):
                mine = mix(few.values.to_numpy().view(U) + U(1)).tolist()
                s, whole = len(mine), sum(mine)
                for t, c in rule.subsets(s, bound):
                    rows += [((whole - sum(gone)) % 2**64, min(s, t) << 32 | max(s, t), name, s, s == t) for gone in combinations(mine, s - c)]
                if len(rows) > 100_000:
                    yield listed(rows)
                    rows = []
            if rows:
                yield listed(rows)

    def listed(rows: list[tuple]) -> pa.RecordBatch:
        left, use, names, sizes, even = zip(*rows, strict=True)
        keys = mix(mix(np.array(left, U)) + np.array(use, U))
        return pa.RecordBatch.from_arrays([_longs(keys), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(even)], names=["key", "set", "size", "even"])

    return sets.select("set", "few").mapInArrow(run, "key long, set long, size int, even boolean")


def light_links(rows: DataFrame, rule: Rule, bound: int) -> DataFrame:
    """a, b: light sets that agree in a subset, each with the least of them; rows: from described().

    Sets of one key link if its use is of one size, or each with all of the other size.
    """
    own = rows.filter(f"few is not null and n_shingles between 1 and {bound}").select("set", "few").dropDuplicates(["set"])
    rows = subsets(own, rule, bound).distinct()
    use = rows.groupBy("key").agg(F.min("set").alias("a"), F.min("size").alias("lo"), F.max("size").alias("hi"), F.max("even").alias("one"), F.count("*").alias("n")).filter("n > 1 and (one or lo < hi)")
    return rows.join(use.select("key", "a"), "key").filter("a <> set").select("a", F.col("set").alias("b")).distinct()


def chosen_bound(sizes: dict[int, int], rule: Rule) -> int:
    """The size up to which listing subsets costs no more rows than lists do; sizes: how many sets have each size."""
    best = light = lists = 0
    for s in range(1, CARRIED + 1):
        lists += sizes.get(s, 0) * int(rule.sent(s))
        light = sum(n * sum(comb(x, c) for _, c in rule.subsets(x, s)) for x, n in sizes.items() if x <= s)
        if light <= lists:
            best = s
    return best


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str], most: int, always: str | None = None) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Runs of rows that agree in the keys: whether it goes on from a run cut before, and its columns.

    A run is cut after most rows. Runs of one row are left out, unless they go on or always is true in them.
    """
    held: list[list[np.ndarray]] = []
    n, again, last = 0, False, None

    def out() -> tuple[bool, list[np.ndarray]]:
        return again, [np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*held, strict=True)]

    def wanted() -> bool:
        return n > 1 or n == 1 and (again or always is not None and bool(held[0][names.index(always)][0]))

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
        own = [cols[names.index(c)] for c in keys]
        new = np.zeros(b.num_rows, bool)
        for c in own:
            new[1:] |= c[1:] != c[:-1]
        new[0] = tuple(int(c[0]) for c in own) != last
        last = tuple(int(c[-1]) for c in own)
        edges = np.append(np.flatnonzero(new), b.num_rows)
        if edges[0]:  # the rest of the run before
            edges = np.insert(edges, 0, 0)
        # most runs are of one row, and of no use; the first and the last may go on in other batches
        keep = np.diff(edges) > 1
        if always is not None:
            keep |= cols[names.index(always)][edges[:-1]].astype(bool)
        keep[[0, -1]] = True
        for at in np.flatnonzero(keep).tolist():
            lo, hi = int(edges[at]), int(edges[at + 1])
            if new[lo]:
                if wanted():
                    yield out()
                held, n, again = [], 0, False
            while lo < hi:
                step = min(hi - lo, most - n)
                held.append([c[lo : lo + step] for c in cols])
                lo, n = lo + step, n + step
                if n == most:
                    yield out()
                    held, n, again = [], 0, True
    if wanted():
        yield out()


def _may(rule: Rule, bound: int, s, t, p, q) -> np.ndarray:
    """Whether sets of s and t, not both light, may link if the p-th and q-th shingle is the first they have in common.

    A pair that links has a first common shingle, so it is told in that list, and need not be in others.
    """
    return (np.minimum(s - p, t - q) >= rule.overlap(s, t)) & (np.maximum(s, t) > bound)


PROPOSED = "a long, b long, key long, size int, pos int"


def proposed(lists: DataFrame, rule: Rule, bound: int) -> DataFrame:
    """a, b of the pairs that lists propose; and, with b null, the members a of long lists, with key, size and pos."""
    keys = ["key", "part"]
    dealt = lists.repartition(parts(lists), *keys).sortWithinPartitions(*keys, "size", "set")

    def stars(sets: np.ndarray, size: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A leader with the others that it may link with; those of no leader lead in turn, some of them."""
        a, b, rest = [], [], np.arange(len(sets))
        for _ in range(LEADERS):
            if len(rest) < 2:
                break
            i, rest = rest[0], rest[1:]
            hit = _may(rule, bound, size[i], size[rest], pos[i], pos[rest])
            a.append(np.full(hit.sum(), sets[i]))
            b.append(sets[rest[hit]])
            rest = rest[~hit]
        return np.concatenate(a), np.concatenate(b)

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        two = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        none = pa.nulls(len(two), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1]), pa.nulls(len(two), pa.int64()), none, none], names=["a", "b", "key", "size", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0
        for again, (key, _, wide, sets, size, pos) in _groups(batches, keys, ["key", "part", "wide", "set", "size", "pos"], BLOCK, "wide"):
            new = np.ones(len(sets), bool)  # tasks that met a set send it each
            new[1:] = sets[1:] != sets[:-1]
            key, sets, size, pos = key[new], sets[new], size[new].astype(np.int64), pos[new].astype(np.int64)
            if again or len(sets) > SHORT or wide[0]:
                some = np.ones(len(sets), bool)
                if len(sets) > 1:
                    x, y = stars(sets, size, pos)
                    a.append(x)
                    b.append(y)
                    held += len(x)
                    if not again and len(sets) < BLOCK and not wide[0]:  # a whole list: who has a partner in it
                        i, j = np.triu_indices(len(sets), 1)
                        ok = _may(rule, bound, size[i], size[j], pos[i], pos[j])
                        some = np.bincount(i[ok], minlength=len(sets)) + np.bincount(j[ok], minlength=len(sets)) > 0
                n = int(some.sum())
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(sets[some]), pa.nulls(n, pa.int64()), pa.array(key[some]), pa.array(size[some].astype(np.int32)), pa.array(pos[some].astype(np.int32))], names=["a", "b", "key", "size", "pos"])
            elif len(sets) > 1:
                i, j = np.triu_indices(len(sets), 1)
                ok = _may(rule, bound, size[i], size[j], pos[i], pos[j])
                if ok.any():
                    a.append(sets[i[ok]])
                    b.append(sets[j[ok]])
                    held += int(ok.sum())
            if held > 200_000:
                yield pairs(np.concatenate(a), np.concatenate(b))
                a, b, held = [], [], 0
        if held:
            yield pairs(np.concatenate(a), np.concatenate(b))

    return dealt.mapInArrow(run, PROPOSED)


def _parities(e: np.ndarray) -> bytes:
    """A bitmap of the parities of a set's cells, of four to eight bits a shingle; of twice the bits, one folds into the other."""
    bits = 1 << max(6, int(4 * len(e) - 1).bit_length())
    odd = np.bincount((mix(e ^ U(0x5851F42D4C957F2D)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class _Bitmaps:
    """Bitmaps of several widths, as one matrix for each width."""

    def __init__(self, bitmaps: np.ndarray):
        self.width = np.array([len(x) for x in bitmaps])
        self.place = np.zeros(len(bitmaps), np.int64)
        self.rows = {}
        for n in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == n)
            self.place[own] = np.arange(len(own))
            self.rows[n] = np.frombuffer(b"".join(bitmaps[i] for i in own), U).reshape(-1, n // 8)

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        """In how many bits the i-th differs from others, the wider folded to the narrower."""
        out = np.zeros(len(others), np.int64)
        for n, rows in self.rows.items():
            same = np.flatnonzero(self.width[others] == n)
            if len(same):
                x, y = rows[self.place[others[same]]], self.rows[int(self.width[i])][self.place[i]][None]
                out[same] = np.bitwise_count(_folded(x, y.shape[1]) ^ _folded(y, x.shape[1])).sum(1)
        return out


def _folded(x: np.ndarray, width: int) -> np.ndarray:
    while x.shape[1] > width:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def whole_sets(docs: DataFrame, k: int, rule: Rule, often: Often, met: DataFrame) -> DataFrame:
    """set, size, bits, elements and first of the sets named in met; a bitmap of bounded size finds them in a second scan.

    first: key, part and wide of the first shingles, in their order; the list of a key
    that is known to be large (wide) is dealt into parts by set.
    """
    many = met.count()
    width = min(MAX_FILTER_BITS, max(12, (FILTER_RATE * many).bit_length()))
    cell = f"shiftrightunsigned(set, {64 - width})"
    words = met.select(F.expr(f"{cell} div 64").alias("word"), F.expr(f"shiftleft(1L, cast({cell} % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (width - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    wanted = docs.sparkSession.sparkContext.broadcast((table, often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, order = wanted.value
        bits = bits.view(U)
        for _, own, size, fresh, doc, e in _each(batches, k):
            at = (own >> U(64 - width)).astype(np.int64)
            hit = fresh & ((bits[at >> 6] >> (at & 63).astype(U)) & U(1) == 1)
            x, sets, size = e[hit[doc]], own[hit], size[hit]
            end = np.cumsum(size)
            if not len(end):
                continue
            maps = [_parities(y) for y in np.split(x, end[:-1])]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]), pa.int32()), _longs(x))
            sent = rule.sent(size)
            row, pos, key, place = _first(order, sent, np.repeat(np.arange(len(size)), size), x)
            turn = np.lexsort((pos, row))
            row, key, place = row[turn], key[turn], place[turn]
            split = np.where(place >= 0, -(-order.counts[place] // SPLIT), 1) if len(order.counts) else np.ones(len(row), np.int64)
            part = ((mix(sets[row]) >> U(8)).astype(np.int64) % split).astype(np.int32)
            first = pa.StructArray.from_arrays([_longs(key), pa.array(part), pa.array(split > 1)], names=["key", "part", "wide"])
            first = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sent)]), pa.int32()), first)
            yield pa.RecordBatch.from_arrays([_longs(sets), pa.array(size.astype(np.int32)), pa.array(maps, pa.binary()), lists, first], names=["set", "size", "bits", "elements", "first"])

    found = docs.select("text").mapInArrow(run, "set long, size int, bits binary, elements array<long>, first array<struct<key: long, part: int, wide: boolean>>")
    return found.join(met, "set", "left_semi").dropDuplicates(["set"])


def near(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that bitmaps do not rule out."""
    one = sets.select(F.col("set").alias("a"), F.col("size").alias("_s"), F.col("bits").alias("_x"))
    two = sets.select(F.col("set").alias("b"), F.col("size").alias("_t"), F.col("bits").alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, t = (b.column(c).to_numpy().astype(np.int64) for c in ("_s", "_t"))
            two = [[np.frombuffer(x, U)[None] for x in b.column(c).to_pylist()] for c in ("_x", "_y")]
            apart = np.array([np.bitwise_count(_folded(x, y.shape[1]) ^ _folded(y, x.shape[1])).sum() for x, y in zip(*two, strict=True)], np.int64)
            yield b.select(["a", "b"]).filter(pa.array(apart <= s + t - 2 * rule.overlap(s, t)))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "_s", "_t", "_x", "_y").mapInArrow(run, PAIR)


PAIR = "a long, b long"


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose sets link."""
    one = sets.select(F.col("set").alias("a"), F.col("elements").alias("_x"))
    two = sets.select(F.col("set").alias("b"), F.col("elements").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    return pairs.join(one, "a").join(two, "b").filter(100 * both >= rule.percent * (F.size("_x") + F.size("_y") - both)).select("a", "b")


def _forest(root: np.ndarray, apart: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Of pairs of members, the most alike ones first, those that join components not joined by ones before."""
    out: list[tuple[int, int]] = []
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    turn = np.argsort(apart, kind="stable")
    for a, b, x, y in zip(i[turn].tolist(), j[turn].tolist(), root[i[turn]].tolist(), root[j[turn]].tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def between(members: DataFrame, rule: Rule, bound: int, best: bool) -> DataFrame:
    """a, b, ra and rb: pairs of members of one list, of different components, that bitmaps do not rule out; best: only the most alike ones that would join all components so met in a block.

    members: key, set, size, pos, bits and root. A list is cut into blocks, and each
    two of its blocks go to one task, whose pairs it alone tells: those of one block
    by the task of that block with itself.
    """
    lists = members.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count("*").alias("_n")).filter("_low <> _high")
    blocks = members.join(lists.select("key", F.expr(f"(_n + {BLOCK - 1}) div {BLOCK}").alias("_n")), "key").withColumn("_b", F.expr("pmod(xxhash64(set), _n)"))
    two = blocks.withColumn("_c", F.explode(F.expr("sequence(0L, _n - 1)")))
    two = two.select("key", F.least("_b", "_c").alias("_lo"), F.greatest("_b", "_c").alias("_hi"), "_b", "set", "size", "pos", "bits", "root")
    keys = ["key", "_lo", "_hi"]
    dealt = two.repartition(parts(two), *keys).sortWithinPartitions(*keys, "size", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (_, lo, hi, block, sets, size, pos, bits, root) in _groups(batches, keys, [*keys, "_b", "set", "size", "pos", "bits", "root"], 1 << 62):
            size, pos = size.astype(np.int64), pos.astype(np.int64)
            maps = _Bitmaps(bits)
            out: list[tuple[int, int, int, int]] = []
            met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i in range(len(sets) - 1):
                j = np.arange(i + 1, len(sets))
                j = j[(root[j] != root[i]) & _may(rule, bound, size[i], size[j], pos[i], pos[j])]
                if lo[0] != hi[0]:
                    j = j[block[j] != block[i]]
                if not len(j):
                    continue
                apart = maps.apart(i, j)
                ok = apart <= size[i] + size[j] - 2 * rule.overlap(size[i], size[j])
                if best:
                    met.append((apart[ok], np.full(int(ok.sum()), i), j[ok]))
                else:
                    out += [(int(sets[i]), int(sets[x]), int(root[i]), int(root[x])) for x in j[ok]]
                if len(out) > 100_000:
                    yield told(out)
                    out = []
            if met:
                out += [(int(sets[i]), int(sets[x]), int(root[i]), int(root[x])) for i, x in _forest(root, *(np.concatenate(c) for c in zip(*met, strict=True)))]
            if out:
                yield told(out)

    def told(out: list[tuple]) -> pa.RecordBatch:
        a = np.array(out, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[:, :2].min(1), a[:, :2].max(1), a[:, 2:].min(1), a[:, 2:].max(1))], names=["a", "b", "ra", "rb"])

    return dealt.mapInArrow(run, "a long, b long, ra long, rb long").distinct()


def _rooted(rows: DataFrame, roots: DataFrame, name: str = "set") -> DataFrame:
    """rows with the root of their set's component; roots: node and root."""
    return rows.join(roots.select(F.col("node").alias(name), F.col("root").alias("_root")), name, "left").withColumn("root", F.coalesce("_root", name)).drop("_root")


def component_roots(rows: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """node and root of the sets that link with others; rows: from described()."""
    rule = Rule(percent)
    sizes = {r["n_shingles"]: r["n"] for r in rows.filter(f"n_shingles between 1 and {CARRIED}").groupBy("n_shingles").agg(F.approx_count_distinct("set").alias("n")).collect()}
    bound = chosen_bound(sizes, rule)
    often = often_of(rows)
    sets = cut(whole_sets(docs, k, rule, often, cut(met_sets(docs, rows, k, rule, bound, often))))
    found = cut(proposed(postings(sets), rule, bound))
    pairs = found.filter("b is not null").select("a", "b").distinct()
    long = found.filter("b is null").select("key", F.col("a").alias("set"), "size", "pos")
    links = verified(cut(near(pairs, sets, rule)), sets, rule)
    if bound:
        links = links.unionByName(light_links(rows, rule, bound))
    roots = components(links)
    if long.isEmpty():
        return roots
    long = long.join(sets.select("set", "bits"), "set")
    for best in (True, True, False):
        more = cut(between(_rooted(long, roots), rule, bound, best))
        if more.isEmpty():  # no pair is left
            break
        ok = verified(more.select("a", "b").distinct(), sets, rule)
        fresh = components(more.join(ok, ["a", "b"], "left_semi").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        # nodes that were roots of nothing but themselves are new
        known = _rooted(roots.select("node", F.col("root").alias("_old")), fresh, "_old").select("node", "root")
        roots = cut(known.unionByName(fresh.join(roots.select("node"), "node", "left_anti").select("node", "root")))
    return roots


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of each row; component_id: the least doc_id that links reach."""
    described_ = cut(described(docs, k))
    roots = component_roots(described_, docs, k, percent)
    rows = described_.filter("n_shingles >= 0").select("doc_id", "set", "n_shingles")
    classes = rows.filter("set is not null").groupBy("set").agg(F.min("doc_id").alias("_id"))
    found = _rooted(classes, roots)
    least = found.groupBy("root").agg(F.min("_id").alias("component_id"))
    named = found.join(least, "root").select("set", "component_id")
    return rows.join(named, "set", "left").select("doc_id", "n_shingles", F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def distinct_texts(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all its columns: one of its least doc_id. Rows without shingles all stay."""
    described_ = cut(described(docs, k))
    roots = component_roots(described_, docs, k, percent)
    rows = described_.filter("set is not null and n_shingles > 0")
    # of equal ranks: rows with an id before those without
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_text").alias("text"))
    first = _rooted(rows.groupBy("set").agg(F.min(name).alias("m")), roots).groupBy("root").agg(F.min("m").alias("m"))
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # rows go by text and doc_id, so that the copies of one text are dealt over many tasks
    stay = first.select(key("m.id").alias("_key"), F.col("m.text").alias("_text"))
    whole = F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("_row")
    own = docs.filter(f"not {BLANK}").select(whole, key("doc_id").alias("_key"), F.xxhash64("text").alias("_text"))
    kept = own.join(stay, ["_key", "_text"], "left_semi").dropDuplicates(["_key", "_text"]).select("_row.*")
    return kept.unionByName(docs.filter(BLANK))

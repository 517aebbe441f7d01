"""Operators that compare rows with each other, against brute force."""

import string
from collections import Counter, defaultdict

import pytest
from loomgrid.llm import chat, components, decontaminate, jaccard, suffixes, warc

from tests.llm.test_rows import words

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="session")
def near(spark, docs):
    """Copies of one text with a word or two changed, exact copies, and small sets that differ by one."""
    base = [f"word{i * 7 % 101}" for i in range(90)]
    texts = [" ".join(base)] * 6
    for i in range(60):
        own = list(base)
        own[i] = f"x{i}"
        texts.append(" ".join(own))
    for n in range(5, 16):
        own = [f"t{i}" for i in range(n)]
        texts += [" ".join(own), " ".join(own).upper(), " ".join([*own, "z"]), " ".join(own[1:])]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{' '.join(f'u{j}{i}' for j in range(20))} {passage} {' '.join(f'v{j}{i}' for j in range(i))}" for i in range(12)]
    extra = spark.createDataFrame([(20_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return docs.unionByName(extra, allowMissingColumns=True)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(near, none, k, percent):
    rows = [(r.doc_id, r.text) for r in near.select("doc_id", "text").collect()]
    sets = [shingles(t, k) for _, t in rows]
    lists, up = defaultdict(list), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for g in s:
            lists[g].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in lists[g] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    want = Counter((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(near, k, percent).collect()) == want
    assert jaccard.join(none, k, percent).count() == 0
    if k == 5:
        kept = jaccard.distinct_texts(near)
        assert kept.columns == near.columns
        roots = {root(i) for i in range(len(rows)) if sets[i]}
        blank = sum(not s for s in sets)
        assert kept.count() == len(roots) + blank


def test_light_and_heavy_agree(near):
    """Where the boundary lies must not change a link."""
    chosen, found = jaccard.chosen_bound, []
    try:
        for bound in (0, 6, 12):
            jaccard.chosen_bound = lambda sizes, rule, bound=bound: bound
            found.append(Counter(map(tuple, jaccard.join(near.filter("doc_id >= 20000"), 3, 90).collect())))
    finally:
        jaccard.chosen_bound = chosen
    assert found[0] == found[1] == found[2]


def test_white_space_is_no_part_of_a_shingle(spark):
    """Texts that differ only in runs of white space are equal sets, and a shingle with two spacings is one."""
    own = [f"w{i}" for i in range(60)]
    gaps = [" ", "  ", "\r\n", "\n\n    ", "\t \t"]
    texts = [g.join(own) for g in gaps] + ["".join(w + gaps[i * 7 % 5] for i, w in enumerate(own))]
    texts += [" ".join([*own[:30], "other", *own[31:]]), "   ".join([*own[:30], "other", *own[31:]])]
    texts += ["a b c  a  b  c a b c", "a b c a b c a b c", "a\n\n\nb c"]
    rows = [(i, t) for i, t in enumerate(texts)]
    want = {(i, 58, 0) for i in range(8)} | {(8, 3, 8), (9, 3, 8), (10, 1, 10)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert set(map(tuple, jaccard.join(df, 3, 90).collect())) == want
    assert {r.doc_id for r in jaccard.distinct_texts(df, 3, 90).collect()} == {0, 8, 10}


def test_components(spark):
    links = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, 3), (3, 100), (7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[i] == i // 10 * 10 for i in range(40)) and got[100] == 0
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_passages(near, none):
    rows = [(r.doc_id, words(r.text)) for r in near.select("doc_id", "text").collect()]
    seen = defaultdict(set)
    for n, (_, w) in enumerate(rows):
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])].add(n)
    want = []
    for n, (d, w) in enumerate(rows):
        span = None
        for i in range(len(w) - 49):
            if len(seen[tuple(w[i : i + 50])]) > 1:
                if span and span[1] >= i:
                    span[1] = i + 50
                else:
                    span = [i, i + 50]
                    want.append((d, span))
    want = Counter((d, a, b - a) for d, (a, b) in want)
    assert Counter(map(tuple, suffixes.passages(near).collect())) == want
    assert suffixes.passages(none).count() == 0


def test_decontamination(spark, small, docs, none):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    extra = [(901, None), (902, ""), (903, "One"), (904, "two words"), (905, "five words make one shingle")]
    items = items.unionByName(spark.createDataFrame(extra, "item_id long, text string"))
    passage = [r.text for r in items.filter("item_id in (1, 2)").collect()]
    more = [(30_000, "before " + passage[0].upper() + " after"), (30_001, " ".join(words(passage[1])[2:])), (30_002, "it is five words make one shingle here"), (30_003, "here are TWO  words again, two words")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    counts = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    own = [(r.item_id, words((r.text or "").translate(LOWER))) for r in items.collect()]
    want = {}
    for r in df.collect():
        w = words((r.text or "").translate(LOWER))
        for t, x in own:
            if not x:
                continue
            if len(x) < 5:
                if any(w[i : i + len(x)] == x for i in range(len(w) - len(x) + 1)):
                    want[r.doc_id, t] = 1.0
                continue
            a, n = counts(x), len(x)
            if len(w) < 5 or not a & counts(w):
                continue
            best = 0
            for i in range(max(1, len(w) - n + 1)):
                b = counts(w[i : i + n])
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.8:
                want[r.doc_id, t] = best
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(df, items).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    assert {(30_000, 1), (30_001, 2), (30_002, 905), (9004, 903), (9005, 903), (30_003, 904)} <= got.keys()
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, _ in got if d < 30_000}
    assert decontaminate.matches(none, items).count() == 0 and decontaminate.matches(docs, items.limit(0)).count() == 0


def test_all_prints_in_radius_are_found(spark, small):
    import numpy as np
    import pyarrow as pa

    items = decontaminate.Items(pa.array([r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]))
    n = next(iter(items.index))
    rng = np.random.default_rng(3)
    prints = np.concatenate([items.print[items.index[n]] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, d, replace=False))) for d in range(40)])
    got = dict(items.candidates(n, prints))
    for t in items.index[n]:
        assert set(got[int(t)]) == set(np.flatnonzero(np.bitwise_count(prints ^ items.print[t]) <= decontaminate.RADIUS))


def test_long_repetitive_text_needs_little_memory():
    """A text of 200,000 words that repeats an item, in a process of its own."""
    import subprocess
    import sys

    code = """
import resource, pyarrow as pa
from loomgrid.llm import decontaminate
item = ' '.join(f'w{i * 7919 % 401}' for i in range(500))
items = decontaminate.Items(pa.array([item, ' '.join(f'z{i}' for i in range(30))]))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
got = items.leaks(pa.array([' '.join([item] * 400), 'no such']))
print(got[0][:5], len(got), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    assert out.startswith("(0, 0, 1.0, 0, 500) 1 ") and int(out.split()[-1]) < 500


def test_revisits(spark):
    rows = [
        (1, "http://www.a.org/x/", 10, "response", 200, {"ETag": '"1"', "Server": "s"}, None), (2, "https://a.org/x?utm_source=f", 20, "response", 200, {"etag": '"2"'}, None),
        (3, "http://a.org/x#top", 15, "revisit", 304, {"ETag": 'W/"1"', "Date": "d", "X": "no"}, None), (4, "a.org/x", 25, "revisit", 304, {"ETag": '"1"'}, None), (5, "a.org/x", 10, "revisit", 304, {}, None),
        (6, "a.org/x", 30, "revisit", 304, {}, None), (7, "b.org", 1, "revisit", 304, {}, None), (8, None, 3, "revisit", 304, {}, None), (9, "a.org/x", 22, "response", 500, {"etag": '"9"'}, None),
        (10, "c.org:80", 1, "response", 200, {}, "d1"), (11, "http://C.org", 2, "revisit", 304, {}, "d2"), (12, "c.org/", None, "revisit", 304, {}, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, status int, headers map<string,string>, digest string")
    got = {r.record_id: (r.outcome, r.response_id, [tuple(x) for x in r.headers] if r.headers is not None else None) for r in warc.resolve(df).collect()}
    assert got == {
        3: ("resolved", 1, [("date", "d"), ("etag", 'W/"1"'), ("server", "s")]), 4: ("mismatch", 2, None), 5: ("no_response", None, None), 6: ("unverified", 2, [("etag", '"2"')]),
        7: ("no_response", None, None), 8: ("no_response", None, None), 11: ("mismatch", 10, None), 12: ("no_response", None, None),
    }
    assert warc.resolve(df.limit(0)).count() == 0


def test_one_url_over_many_partitions(spark):
    rows = [(i, "hot.org", i, "response" if i % 50 == 0 else "revisit", 200, {"etag": f'"{i // 50}"'}, None) for i in range(3000)]
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, status int, headers map<string,string>, digest string")
    got = warc.resolve(df).collect()
    assert len(got) == 2940 and all(r.outcome == "resolved" and r.response_id == r.record_id // 50 * 50 for r in got)


def test_chat_templates(spark):
    turns = [(1, i, "assistant" if i % 2 else "user", f"say {i} </turn> \\ # <x") for i in range(700)] + [(2, 0, None, None), (2, 0, "user", "b"), (2, 0, "user", "a"), (None, None, "user", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    blocks = chat.render(df).orderBy("conv_id", "block").collect()
    one = [b for b in blocks if b.conv_id == 1]
    assert len(one) == 3 and "".join(b.formatted for b in one) == chat.marked([(r, t) for c, _, r, t in turns if c == 1])
    assert all(not b.rewrites_history for b in blocks)
    for b in one:
        for s, (role, text) in zip(b.turn_spans, chat.read_back(b.formatted), strict=True):
            assert chat.unescape(b.formatted[s.text_start : s.text_stop]) == text and s.role == role
    got = {r.conv_id: r for r in chat.digests(chat.render(df)).collect()}
    assert got[2].n_turns == 3 and got[None].n_turns == 1 and got[1].n_turns == 700
    last_only = lambda t: "".join(f"[{r}]{x if i == len(t) - 1 else '...'}" for i, (r, x) in enumerate(t))
    assert all(b.rewrites_history for b in chat.render(df.filter("conv_id = 1"), last_only).collect())
    assert chat.digests(chat.render(df.limit(0))).count() == 0


def test_chat_marks_are_reversible():
    for text in ("", "\\", "###", "</turn>\n### user: x</turn>", "\\\\<", "a:b\n#", "é🎉"):
        assert chat.read_back(chat.marked([("user", text), (f"r:{text}\n", text)])) == [("user", text), (f"r:{text}\n", text)]


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != "shards":
            assert out.columns == docs.columns
        seen.append(out.count())
        docs = out
    assert seen[0] > seen[1] > seen[2] >= seen[3] > 0 and seen[4] == seen[5]
    assert corpus_pipeline.run(spark, small).count() == seen[5]


def test_pipeline_on_empty_tables(spark, small, none):
    import corpus_pipeline

    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0

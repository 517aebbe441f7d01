"""Source divergence, periodic runs and license scans, against SQL and plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from loomgrid.llm import divergence, license_rules, licenses, periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def audited(docs, min_docs, top):
    """The audit in plain Python, from its definition."""
    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    count, held, groups = defaultdict(int), defaultdict(int), set()
    for r in docs:
        lang, source = r["lang"] or "", r["source"] or ""
        groups.add((lang, source))
        found = terms.findall((r["text"] or "").translate(lower))
        for t in found:
            count[lang, source, t] += 1
        for t in set(found):
            held[lang, t] += 1
    kept = defaultdict(list)
    for (lang, t), n in held.items():
        if n >= min_docs:
            kept[lang].append(t)
    out = []
    for lang in {g[0] for g in groups}:
        v, sources = kept[lang], [s for g, s in groups if g == lang]
        own = {s: {t: count.get((lang, s, t), 0) for t in v} for s in sources}
        all_ = {t: sum(own[s][t] for s in sources) for t in v}
        p = lambda n: {t: 1 + 10**9 * (c + 5) // (sum(n.values()) + 5 * len(v)) for t, c in n.items()}
        shares, q = {s: p(own[s]) for s in sources}, p(all_)
        for s in sources:
            far = [(-sum(abs(shares[s][t] - shares[o][t]) for t in v), o.encode(), o) for o in sources if o != s]
            more = [(q[t] - shares[s][t], t.encode(), t) for t in v if own[s][t] and shares[s][t] > q[t]]
            out += [(lang, s, "pair", o, -n, i) for i, (n, _, o) in enumerate(sorted(far), 1)]
            out += [(lang, s, "term", t, -n, i) for i, (n, _, t) in enumerate(sorted(more)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "block", "chunk"), [(2, 32, 2048), (3, 2, 3), (10**6, 4, 16)])
def test_divergence(docs, rows, min_docs, block, chunk):
    """Also tiles of two groups by a few terms, and no term kept at all."""
    got = divergence.audit(docs, min_docs, 50, block, chunk)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audited(rows, min_docs, 50)


def test_divergence_query_agrees_with_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    rel = con.sql(queries.ORACLE["op11_source_divergence"])
    got = queries.op11_source_divergence(spark, small)
    assert got.columns == rel.columns and sorted(map(tuple, got.collect())) == sorted(rel.fetchall())


def test_divergence_of_nothing(none):
    assert divergence.audit(none).count() == 0


def test_shares_of_many_words():
    import numpy as np

    whole = 8 * 10**15
    counts = np.array([0, 1, 10**9, 7 * 10**15, whole - 5], np.int64)
    assert divergence.shares(counts, whole).tolist() == [1 + 10**9 * (int(c) + 5) // whole for c in counts]


def defined_runs(x):
    """Runs by their definition: every stretch, its smallest period, and whether it can be extended."""
    out = []
    for a in range(len(x)):
        for b in range(a + 6, len(x) + 1):
            q = next(q for q in range(1, b - a + 1) if x[a : b - q] == x[a + q : b])
            if b - a >= 4 * q and not (a and x[a - 1] == x[a - 1 + q]) and not (b < len(x) and x[b] == x[b - q]):
                out.append((a, b - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words():
    import random

    rng = random.Random(4)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 3 + ["a"], ["a"] * 30 + ["b"] + ["a"] * 30, list("abaababaabaab") * 4]
    for n in range(60):
        out.append([rng.choice("ab") for _ in range(n)])
        turn = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        out.append([rng.choice("abc") for _ in range(rng.randint(0, 9))] + (turn * 9)[: rng.randint(1, 50)] + [rng.choice("abc") for _ in range(rng.randint(0, 9))])
    return out


def test_runs_by_definition():
    """All documents at once, in one block of pairs and in blocks of a few."""
    import pyarrow as pa

    from loomgrid.llm.words import Words

    own = some_words()
    hashes = Words(pa.array([" ".join(w) for w in own])).hash
    want = [defined_runs(w) for w in own]
    assert periodic.runs(own, hashes) == want and [periodic.runs_by_word(w) for w in own] == [sorted(r) for r in want]
    periodic.PAIRS, before = 7, periodic.PAIRS
    try:
        assert periodic.runs(own, hashes) == want
    finally:
        periodic.PAIRS = before


def test_runs_survive_hashes_that_agree_by_chance():
    import numpy as np

    own = some_words()
    values = np.ones(sum(map(len, own)), np.uint64)
    assert periodic.runs(own, values) == [defined_runs(w) for w in own]


def test_long_repeats_take_no_quadratic_time():
    import time

    import pyarrow as pa

    from loomgrid.llm.words import Words

    own = [["again"] * 400_000, [f"w{i % 1000}" for i in range(400_000)]]
    hashes = Words(pa.array([" ".join(w) for w in own])).hash
    began = time.perf_counter()
    assert periodic.runs(own, hashes) == [[(0, 400_000, 1)], [(0, 400_000, 1000)]]
    assert time.perf_counter() - began < 60


def test_periodic_query(spark, small):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for r in docs:
        w = WORD.findall(r.text or "")
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        runs = periodic.runs_by_word(w)
        runs.sort(key=lambda x: (x[0], x[2]))
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (r.doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
        assert tuple(got[r.doc_id]) == want
    assert planted > 5


def test_periodic_odd_rows(docs, none):
    found = periodic.detect(periodic.planted(docs))
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"] and found.count() == docs.count()
    by = {r.doc_id: r for r in periodic.detect(docs).collect()}
    assert by[9001].runs == by[9002].runs == [] and by[9001].collapsed == by[9003].collapsed == ""
    assert [tuple(x) for x in by[9007].runs] == [(0, 90, 1)] and by[9007].collapsed == "same"
    assert [tuple(x) for x in by[9011].runs] == [(0, 30_000, 997)] and by[9011].n_words == 30_000
    assert by[None].collapsed == "no id here" and periodic.longest(periodic.detect(none)).count() == 0


NOTICES = [
    ("Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in\n * compliance with the License.", {"apache-2.0"}),
    ("// SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}), ("Released under the MIT License.", {"mit"}), ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc-4.0"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}),
    ("the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", {"gpl", "lgpl-2.1-or-later"}),
    ("Mozilla Public License, v. 2.0. http://mozilla.org/MPL/2.0/", {"mpl-2.0"}), ("Alle Rechte vorbehalten. Tous droits réservés", {"rights-de", "rights-fr"}),
    ("© 2021 Someone. All Rights\n# Reserved", {"copyright", "reserved"}), ("free licence plates, submit mitigation; the mit", set()), ("CC-BY", {"cc-by"}), ("ccc by", set()),
    ("Boost Software License - Version 1.0. WTFPL! cc0", {"bsl-1.0", "wtfpl", "cc0-1.0"}), ("https://creativecommons.org/licenses/by-sa/4.0/", {"cc-by-sa-4.0"}),
]


def plainly(text):
    """Words, base places and kept detections without keywords, byte ranges or binary search."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    base = sorted((i, label) for label, phrase in license_rules.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    joined = " ".join(words)
    word_of = lambda at: joined[:at].count(" ")
    rules = [(r, re.compile(r.pattern.pattern.decode())) for r in license_rules.RULES]
    found = {(r.rank, word_of(m.start()), word_of(m.end()) + 1, r.label, m.start(), m.end()) for r, p in rules for m in p.finditer(joined)}
    kept = []
    for kind, a, b, label, i, j in sorted(found, key=lambda x: (x[0], len(joined[x[4] : x[5]].encode()) * -1, x[4], x[3])):
        if not any(x <= a and b <= y or (k < kind and a < y and x < b) for k, x, y, _ in kept):
            kept.append((kind, a, b, label))
    return words, base, sorted((a, b - a, list(license_rules.KINDS)[k], label) for k, a, b, label in kept)


def test_notices(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = licenses.scan(df).select("doc_id", licenses.labels("base", "found").alias("labels"), "score").collect()
    assert {r.doc_id: set(r.labels.split(",")) - {""} for r in got} == {i: want for i, (_, want) in enumerate(NOTICES)}
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)


def test_license_scan(spark, docs, rows, none):
    """Whole documents, and notices put between their words, some of them very often."""
    import random

    rng = random.Random(8)
    made = [(20_000 + i, " ".join(rng.choice([*(t for t, _ in NOTICES), "and", "a file", "GNU", "license"]) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    made += [(30_000, "Copyright (c) 2020 All rights reserved. MIT License. " * 300), (30_001, None)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    extra = df.selectExpr("*", "1 as base", "2 as found", "3 as score", "4 as n_words")
    key = lambda x: repr(x)
    got = sorted(((r.doc_id, r.n_words, [(s.first_word, s.label) for s in r.base], [(s.first_word, s.n_words, s.kind, s.label) for s in r.found]) for r in licenses.scan(extra).collect()), key=key)
    want = []
    for doc_id, text in [(r["doc_id"], r["text"]) for r in rows] + made:
        words, base, found = plainly(text)
        want.append((doc_id, len(words), base, found))
    assert [(*g[:3], sorted(g[3])) for g in got] == sorted(want, key=key)
    assert licenses.scan(none).count() == 0


def test_license_query(spark, small):
    got = {r.doc_id: r for r in queries.op13_license_scan(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        words, base, found = plainly(r.text)
        names = sorted({x for _, x in base})
        own = got[r.doc_id]
        assert (own.n_words, own.n_base, own.first_word, own.last_word, own.base_labels) == (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(names))
        assert own.labels == ",".join(sorted({*names, *(x for *_, x in found)})) and 0 <= own.score <= 1
    assert sum(r.labels != "" for r in got.values()) > 0


def test_pieces_of_long_texts():
    text = ("some words and All rights reserved " * 1000).encode()
    whole = licenses.folded(text)
    licenses.PIECE, before = 100, licenses.PIECE
    try:
        assert licenses.folded(text) == whole
    finally:
        licenses.PIECE = before


def test_signatures():
    """Hundreds of rules, each with a keyword that its matches hold; suppression needs few comparisons."""
    assert len(license_rules.RULES) > 400
    assert sum(r.kind not in "SP" for r in license_rules.RULES) > 250
    assert [r.rank for r in license_rules.RULES] == sorted(r.rank for r in license_rules.RULES)
    many = [(4, 10 * i, 10 * i + 9, "x") for i in range(50_000)] + [(5, 10 * i + 1, 10 * i + 5, "y") for i in range(50_000)]
    assert licenses.resolved(many) == [(4, 10 * i, 10 * i + 9, "x") for i in range(50_000)]

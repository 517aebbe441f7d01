"""License scans by ordered signature rules.

A text becomes its words (runs of ASCII digits and letters, A-Z lower-cased, and of
code points beyond ASCII), joined by single spaces, so that line breaks, comment
marks and punctuation inside a notice do not matter. Hundreds of expressions
(license_rules.py) are tried on it, each only where the text has the rule's keyword:
the words are intersected with all keywords once, and few texts hold any.

Detections are resolved in the order of the rules' kinds, then longer ones first. One
that lies within a detection kept before it goes, and so does one that overlaps a
kept one of a stronger kind. So `gnu general public license version 3` is one
detection, not also that of its family. Detections kept never contain each other, so
both ends are sorted, and each new one needs two binary searches.

Three fixed phrases are told of at all their places, besides and unaffected.

Defined results: a null or empty text has no words and no detection. Very long texts
are read whole; their words are listed PIECE bytes at a time. Repeated rows are
scanned each. An empty table gives no rows. Extra columns of any name are ignored.
Expressions are tried from the left, and one rule's matches do not overlap.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm.license_rules import BASE, KINDS, RULES
from loomgrid.llm.words import slices

#: Bytes of a text whose words are listed at once.
PIECE = 1 << 22
#: Bytes to lower-case word bytes; all others to a space.
_FOLD = bytes(x | 0x20 if 0x41 <= x <= 0x5A else x if 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x >= 0x80 else 0x20 for x in range(256))
_PHRASES = [(label, f" {phrase} ".encode()) for label, phrase in BASE]
_GATES = frozenset([r.gate for r in RULES] + [p.split()[-1] for _, p in _PHRASES])


def folded(text: bytes) -> tuple[bytes, frozenset, int]:
    """The words of a UTF-8 text joined by spaces, which keywords are among them, and their number."""
    plain, out, met, n, at = text.translate(_FOLD), [], frozenset(), 0, 0
    while at < len(plain):
        stop = plain.find(b" ", at + PIECE)
        stop = len(plain) if stop < 0 else stop
        words = plain[at:stop].split()
        met |= _GATES.intersection(words)
        n += len(words)
        if words:
            out.append(b" ".join(words))
        at = stop
    return b" ".join(out), met, n


def phrases(plain: bytes, met: frozenset) -> list[tuple[str, int, int]]:
    """Label and byte range of all places of the fixed phrases."""
    out = []
    padded = None
    for label, phrase in _PHRASES:
        if phrase.split()[-1] in met:
            padded = b" " + plain + b" " if padded is None else padded
            at = padded.find(phrase)
            while at >= 0:
                out.append((label, at, at + len(phrase) - 2))
                at = padded.find(phrase, at + 1)
    return out


def resolved(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """The detections (kind, start, end, label) that remain, by start. Kinds: the less, the stronger."""
    lo: list[int] = []
    hi: list[int] = []
    kept: list[tuple[int, int, int, str]] = []
    strong: list[int] = []
    for kind, a, b, label in sorted(set(found), key=lambda x: (x[0], x[1] - x[2], x[1], x[3])):
        # the kept ones that overlap [a, b): starts before b, ends after a
        i, j = bisect_right(hi, a), bisect_left(lo, b)
        if i < j:
            within = any(lo[k] <= a and b <= hi[k] for k in (i, j - 1, bisect_right(lo, a) - 1) if i <= k < j)
            if within or min(strong[i:j]) < kind:
                continue
        k = bisect_left(lo, a)
        lo.insert(k, a)
        hi.insert(k, b)
        strong.insert(k, kind)
        kept.insert(k, (kind, a, b, label))
    return kept


def detections(plain: bytes, met: frozenset) -> list[tuple[int, int, int, str]]:
    """Kind, byte range and label of what the rules find and resolution keeps."""
    found = [(r.rank, m.start(), m.end(), r.label) for r in RULES if r.gate in met for m in r.pattern.finditer(plain)] if met else []
    return resolved(found)


SPAN = "struct<label:string,kind:string,first_word:bigint,n_words:bigint>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (the fixed phrases) and found (the rules' detections), arrays of label, kind, first_word and n_words, and score.

    score: the confidence of the strongest detection, the more of the text's words are in detections the nearer to 1.
    """
    kinds = list(KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sizes, base, found, scores = [], [], [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                plain, met, n = folded(text or b"")
                own, other = phrases(plain, met), detections(plain, met)
                rows = []
                if own or other:
                    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
                    for told in ([(x, "B", a, z) for x, a, z in own], [(x, kinds[k], a, z) for k, a, z, x in other]):
                        first = np.searchsorted(gaps, [a for _, _, a, _ in told])
                        last = np.searchsorted(gaps, [z for _, _, _, z in told])
                        rows.append([{"label": x, "kind": k, "first_word": int(i), "n_words": int(j - i) + 1} for (x, k, _, _), i, j in zip(told, first, last, strict=True)])
                else:
                    rows = [[], []]
                sure = max([KINDS[kinds[k]] for k, *_ in other] + [KINDS["G"]] * bool(own), default=0) / 100
                covered, upto = 0, -1
                for s in sorted((r["first_word"], r["first_word"] + r["n_words"]) for part in rows for r in part):
                    covered += max(0, s[1] - max(s[0], upto))
                    upto = max(upto, s[1])
                sizes.append(n)
                base.append(sorted(rows[0], key=lambda r: (r["first_word"], r["label"])))
                found.append(rows[1])
                scores.append(sure + (1 - sure) * covered / n if sure else 0.0)
            kind = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(base, kind), pa.array(found, kind), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "base", "found", "score"])

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(f"n_words long, base array<{SPAN}>, found array<{SPAN}>, score double")])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def labels(*columns: str):
    """The distinct labels of these arrays, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(c, lambda s: s["label"]) for c in columns)))), ",")

"""Commit logs with changed lines per path, as a table function.

A block is one commit: its id, a tab and its subject, then records closed by NUL: added
and deleted lines and the path, with tabs between; a rename has no path there, but the
old and the new one as two records of their own. Binary files count `-`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RECORD = re.compile(r"\n*(\d+|-)\t(\d+|-)\t(.*)", re.DOTALL)


@F.udtf(returnType="sha string, subject string, path string, lines bigint, renamed_from string")
class Numstat:
    """One row a path that a commit changes in lines; a null block has none."""

    def eval(self, block: str) -> Iterator[tuple]:
        if block is None:
            return
        head, *rest = block.split("\0")
        sha, _, subject = head.partition("\t")
        found: dict[str, list] = {}
        records = iter(rest)
        for record in records:
            hit = _RECORD.fullmatch(record)
            if hit is None:
                continue
            added, deleted, path = hit.groups()
            before = None
            if not path:
                before, path = next(records, ""), next(records, "")
            if added != "-":
                own = found.setdefault(path, [0, before])
                own[0] += int(added) + int(deleted)
        for path, (lines, before) in found.items():
            yield sha, subject, path, lines, before


def numstat(logs: DataFrame, block: str = "block") -> DataFrame:
    """sha, subject, path, lines and renamed_from of every path of every commit; logs: a block of text a commit."""
    spark = logs.sparkSession
    spark.udtf.register("_numstat", Numstat)
    return spark.sql(f"select n.* from {{logs}} l, lateral _numstat(l.`{block}`) n", logs=logs)

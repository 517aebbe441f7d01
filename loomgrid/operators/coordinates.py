"""Source coordinates: lines and columns to bytes, bytes to characters, and what owns a coordinate.

Texts are read once, where they are, into an index of their lines: offsets, and the
line itself only where it has characters beyond ASCII, as elsewhere a column is a byte.
Coordinates meet the index by (path, line), points meet ranges by bins of bytes.

Defined results: a null text has no lines, an empty one has a single empty line. A
coordinate outside its file or line, or in an unknown file, has no point. Very long
lines are one row each, whole only if they are not ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.operators.sequence import owner_of_points, points_within

#: Rows of a batch that is passed on.
ROWS = 20_000


def _pieces(key: pa.Array, n: list[int], columns: list[tuple[str, np.ndarray | list]], name: str) -> Iterator[pa.RecordBatch]:
    keys = key.take(pa.array(np.repeat(np.arange(len(n)), n)))
    table = pa.RecordBatch.from_arrays([keys, *(c if isinstance(c, pa.Array) else pa.array(c) for _, c in columns)], names=[name, *(x for x, _ in columns)])
    for i in range(0, table.num_rows, ROWS):
        yield table.slice(i, ROWS)


def _breaks(raw: np.ndarray, any_break: bool) -> np.ndarray:
    """Where the lines after the first start."""
    at = np.flatnonzero((raw == 10) | (raw == 13)) if any_break else np.flatnonzero(raw == 10)
    if any_break and len(at):
        # a carriage return before a line feed is no break of its own
        at = at[~((raw[at] == 13) & (np.append(raw, 0)[at + 1] == 10))]
    return at + 1


def line_index(files: DataFrame, key: str = "path", text: str = "source", any_break: bool = False) -> DataFrame:
    """key, line_no, start_byte, end_byte (with its line break, half open), start_char, lead (blanks it begins with) and wide (the line, if it is not ASCII) of each line.

    any_break: lines also end with CR and CRLF, not only with LF.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = batch.column(1)[i].as_py()
                if value is None:
                    continue
                data = value.encode()
                raw = np.frombuffer(data, np.uint8)
                start = np.concatenate([[0], _breaks(raw, any_break)]).astype(np.int64)
                end = np.append(start[1:], len(raw))
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                stops = np.append(np.flatnonzero((raw != 32) & (raw != 9)), len(raw))
                lead = np.minimum(stops[np.searchsorted(stops, start)], end) - start
                wide = [data[a:b].decode() if n != b - a else None for a, b, n in zip(start.tolist(), end.tolist(), (chars[end] - chars[start]).tolist(), strict=True)]
                columns = [("line_no", np.arange(1, len(start) + 1)), ("start_byte", start), ("end_byte", end), ("start_char", chars[start]), ("lead", lead), ("wide", pa.array(wide, pa.string()))]
                yield from _pieces(batch.column(0).slice(i, 1), [len(start)], columns, key)

    schema = T.StructType([files.schema[key], *T.StructType.fromDDL("line_no long, start_byte long, end_byte long, start_char long, lead long, wide string")])
    return files.select(key, text).mapInArrow(run, schema)


def points(coordinates: DataFrame, index: DataFrame, key: str = "path") -> DataFrame:
    """The coordinates (key, line, column) that have a point, with it; a null column is the first one after the line's blanks.

    Columns count characters from 1 and may be one beyond the line's end, its break included.
    """
    met = coordinates.join(index.withColumnRenamed("line_no", "line"), [key, "line"])
    column, length = F.col("column"), F.coalesce(F.length("wide").cast("long"), F.col("end_byte") - F.col("start_byte"))
    inside = F.when(F.col("wide").isNull(), column - 1).otherwise(F.octet_length(F.expr("left(wide, cast(column - 1 as int))")).cast("long"))
    point = F.when(column.isNull(), F.col("start_byte") + F.col("lead")).when((column >= 1) & (column <= length + 1), F.col("start_byte") + inside)
    return met.withColumn("point", point).filter("point is not null").select(*coordinates.columns, "point")


def owners(coordinates: DataFrame, index: DataFrame, ranges: DataFrame, key: str = "path") -> DataFrame:
    """The coordinates that lie in a range, with the first such range by ordinal as owner; ranges: key, range_id, start_byte, end_byte, ordinal."""
    at = points(coordinates, index, key)
    owned = owner_of_points(at.select(key, "point").distinct(), ranges, key)
    return at.join(owned, [key, "point"])


def edge_coordinates(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, path, line and column at which each edge's owner stands: a call's own place, else the start of its source node's owner.

    edges: id, kind, source, path, line, column; nodes: id, path, start_line, owner.
    """
    own = nodes.select(F.col("id").alias("source"), F.col("path").alias("_path"), F.col("start_line").alias("_line"), F.col("owner").alias("_owner"))
    held = nodes.select(F.col("id").alias("_owner"), F.col("path").alias("_held_path"), F.col("start_line").alias("_held_line"), F.lit(True).alias("_held"))
    # nodes look their owners up, not edges; those without one take no part, as all of them would meet in one task
    alone = own.filter("_owner is null").select("source", "_path", "_line", *(F.lit(None).cast(held.schema[c].dataType).alias(c) for c in held.columns[1:]))
    own = own.filter("_owner is not null").join(held, "_owner", "left").select(*alone.columns).unionByName(alone)
    met = edges.select("id", "kind", "source", "path", "line", "column").join(own, "source", "left")
    call = F.col("kind") == "call"
    return met.select(
        "id", F.when(call, F.coalesce("path", "_path")).when(F.col("_held"), F.col("_held_path")).otherwise(F.col("_path")).alias("path"),
        F.when(call, F.col("line")).when(F.col("_held"), F.col("_held_line")).otherwise(F.col("_line")).cast("long").alias("line"), F.when(call, F.col("column")).cast("long").alias("column"),
    )


def chars_of_bytes(points_: DataFrame, index: DataFrame, key: str = "path", width: int = 4096) -> DataFrame:
    """The character at each byte (key, point) of a file; the end of the file is its number of characters, what lies beyond has none."""
    last = index.groupBy(key).agg(F.max("end_byte").alias("_size"))
    # the end of the file is a point of its last line
    close = F.when(F.col("end_byte") == F.col("_size"), F.col("end_byte") + 1).otherwise(F.col("end_byte"))
    lines = index.join(last, key).withColumn("_close", close).filter("_close > start_byte")
    met = points_within(points_, lines, key, "point", "start_byte", "_close", width)
    return met.select(*points_.columns, (F.col("start_char") + F.when(F.col("wide").isNull(), F.col("point") - F.col("start_byte")).otherwise(_leads())).alias("char"))


def _leads():
    """Characters of `wide` that begin before the byte after the point, less one."""
    byte = F.expr("substring(hex(encode(wide, 'UTF-8')), 1, 2 * cast(point - start_byte + 1 as int))")
    # bytes 80 to BF continue a character
    begun = F.length(F.regexp_replace(F.regexp_replace(byte, "(..)", "$1 "), "[89AB]. ", "")) / 3
    return F.when(F.col("point") < F.col("end_byte"), begun.cast("long") - 1).otherwise(F.length("wide").cast("long"))

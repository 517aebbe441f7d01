"""Facts of Python sources by the standard library's ast, and token counts, as table and Arrow functions.

A source is parsed in pieces of whole top-level statements, as a syntax tree takes
some hundred times the room of its text: of a long source only one piece's tree is
held at a time, beside its facts in Arrow columns.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType
from pyspark.sql.pandas.types import to_arrow_schema

MOST = 160
#: Characters of a piece of a source, unless its statements are longer.
PIECE = 1 << 15
#: Bytes of an Arrow batch; a row of more goes alone.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: A line that begins a top-level statement, if what comes before it parses.
_STATEMENT = re.compile(r"^(?!(?:else|elif|except|finally)\b)(?:[^\W\d]|@)", re.M)


def small_batches(files: DataFrame) -> DataFrame:
    """The same rows; the session sends Arrow batches of BATCH_BYTES from now on, unless it sets a bound of its own."""
    conf = files.sparkSession.conf
    if BATCH_SETTING not in conf.getAll:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return files


def _trees(source: str) -> Iterator[tuple[ast.Module, int]]:
    """The trees of a source's pieces, and the lines before each; raises where the source does not parse.

    A text that parses alone ends outside of strings and brackets, so that what follows
    begins a statement unless it begins with a word that goes on with the last one.
    """
    at, line, size = 0, 0, PIECE
    while True:
        found = _STATEMENT.search(source, at + size) if at + size < len(source) else None
        end = found.start() if found else len(source)
        piece = source[at:end]
        try:
            tree = ast.parse(piece)
        except (SyntaxError, ValueError, RecursionError):
            if end == len(source):
                raise
            size = 2 * (end - at)
            continue
        yield tree, line
        if end == len(source):
            return
        line += piece.count("\n") + piece.count("\r") - piece.count("\r\n")
        at, size = end, PIECE


def _short(node: ast.AST) -> str:
    return ast.unparse(node)[:MOST]


def _facts(tree: ast.Module, before: int) -> list[tuple[str, str, str, int]]:
    out: list[tuple[str, str, str, int]] = []

    def walk(node: ast.AST, owner: str) -> None:
        for x in ast.iter_child_nodes(node):
            name = owner
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
                name = f"{owner}.{x.name}".strip(".")
                own = x.args.posonlyargs + x.args.args
                pairs = list(zip(own[len(own) - len(x.args.defaults) :], x.args.defaults, strict=True)) + [(a, v) for a, v in zip(x.args.kwonlyargs, x.args.kw_defaults, strict=True) if v is not None]
                out.extend(("param_default", name, f"{a.arg}={_short(v)}", before + v.lineno) for a, v in pairs)
            elif isinstance(x, ast.ClassDef):
                name = f"{owner}.{x.name}".strip(".")
            elif isinstance(x, ast.Assign) and len(x.targets) == 1 and isinstance(x.targets[0], ast.Name) and x.targets[0].id.isupper():
                out.append(("constant", f"{owner}.{x.targets[0].id}".strip("."), _short(x.value), before + x.lineno))
            elif isinstance(x, ast.Raise) and x.exc is not None:
                out.append(("raise", owner, _short(x.exc), before + x.lineno))
            elif isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr == "add_argument":
                out.append(("option", owner, _short(x)[:MOST], before + x.lineno))
            walk(x, name)

    walk(tree, "")
    return out


def _declarations(tree: ast.Module, before: int) -> list[tuple[str, str, int, int]]:
    out: list[tuple[str, str, int, int]] = []

    def walk(node: ast.AST, owner: str, inside: bool) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = f"{owner}.{x.name}".strip(".")
                kind = "class" if isinstance(x, ast.ClassDef) else "method" if inside else "function"
                out.append((kind, name, before + x.lineno, before + (x.end_lineno or x.lineno)))
                walk(x, name, isinstance(x, ast.ClassDef))
            else:
                walk(x, owner, inside)

    walk(tree, "", False)
    return out


def _whole(source: str, found: Callable[[ast.Module, int], object]) -> list:
    """What is found in each piece; nothing if the source does not parse."""
    out = []
    try:
        for tree, before in _trees(source):
            out.append(found(tree, before))
            del tree
    except (SyntaxError, ValueError, RecursionError):
        return []
    return out


def facts(source: str) -> list[tuple[str, str, str, int]]:
    """kind, symbol, text and line of parameter defaults, constants, options and raises; nothing if it does not parse."""
    return [x for own in _whole(source, _facts) for x in own]


def declarations(source: str) -> list[tuple[str, str, int, int]]:
    """kind, qualified name, first and last line of classes and functions."""
    return [x for own in _whole(source, _declarations) for x in own]


def _table(files: DataFrame, function: Callable[[ast.Module, int], list[tuple]], schema: str) -> DataFrame:
    fields = StructType.fromDDL(f"path string, {schema}")
    kinds = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, source in zip(*batch.columns, strict=True):
                name = path.as_py()

                def rows(tree: ast.Module, before: int) -> pa.RecordBatch:
                    own = function(tree, before)
                    columns = zip(*own, strict=True) if own else [[]] * (len(kinds) - 1)
                    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[name] * len(own), *columns], kinds.types, strict=True)], schema=kinds)

                yield from _whole(source.as_py() or "", rows)

    return small_batches(files).select("path", "source").mapInArrow(run, fields)


def python_facts(files: DataFrame) -> DataFrame:
    return _table(files, _facts, "kind string, symbol string, text string, line int")


def python_declarations(files: DataFrame) -> DataFrame:
    return _table(files, _declarations, "kind string, name string, start_line int, end_line int")


def token_counts(files: DataFrame, encoding: str) -> DataFrame:
    """path and tokens under a tiktoken encoding file of byte ranks (base64 and rank a line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(encoding, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        coder = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            # one text and its tokens at a time
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(coder.encode_ordinary(s.as_py() or "")) for s in batch.column(1)], pa.int64())], names=["path", "tokens"])

    return small_batches(files).select("path", "source").mapInArrow(run, StructType.fromDDL("path string, tokens long"))


def casefolded(text: Column) -> Column:
    """Full case folding, which maps ß to ss where lower() does not."""
    return F.pandas_udf(lambda s: s.str.casefold(), StringType())(text)

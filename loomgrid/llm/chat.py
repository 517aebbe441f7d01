"""Chat formatting: incremental rendering of a black-box template.

A template is any function from the turns of a conversation to a string. It is
rendered for successive prefixes of the turns; what a render adds to the one
before is the span of the new turn. A template that changes what it wrote before
rewrites history, and is marked so. The loss mask is the part of each assistant
span that holds the turn's own text, found by rendering the turn with two other
texts and comparing those from both ends.

A conversation may be very long, and rendering all its prefixes would take
quadratic time. Conversations are therefore cut into blocks of BLOCK turns; a
block is rendered after the LEAD turns before it, and its own first turns are
rendered again at the end of the block before, so that a template which looks
further back than LEAD turns shows up as one that rewrites history. A block is
one row; whole conversations are read back by streaming their blocks in order.

The template used here marks turns by `### Role: ` and `</turn>` and escapes
backslash, `#`, `<` and, in roles, `:` and line breaks by a backslash, so that no
text can forge a mark and reading back restores it.

Defined results: null text or role: empty. Rows that tie in turn go by role, then
text. A null turn comes first. A null conv_id is a conversation of its own.
Repeated rows are turns of their own. An empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.ordered import parts, ranked

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]
BLOCK, LEAD = 256, 2


def escape(text: str) -> str:
    return re.sub(r"([\\#<])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def marked(turns: Sequence[Turn]) -> str:
    """`### Role: text</turn>` and a line break for each turn."""
    return "".join(f"### {re.sub(r'([:\n])', r'\\\1', escape(role))}: {escape(text)}</turn>\n" for role, text in turns)


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)


def read_back(text: str) -> list[Turn]:
    """The turns that marked() wrote."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def spans(turns: Sequence[Turn], template: Template, lead: int = 0) -> tuple[list[tuple[int, int, int, int]], str, bool]:
    """For each turn after the first lead ones: its span in the last render, and where in it its own text lies.

    Also that render, and whether a render changed what an earlier one had written.
    """
    before, rewrites, out = template(turns[:lead]), False, []
    for k in range(lead, len(turns)):
        now = template(turns[: k + 1])
        rewrites |= not now.startswith(before)
        x, y = (template([*turns[:k], (turns[k][0], t)]) for t in "xy")
        head = _common(x, y, 0)
        tail = _common(x[:head:-1], y[:head:-1], 0)
        if now[:head] == x[:head] and now[len(now) - tail :] == x[len(x) - tail :]:
            out.append((len(before), len(now), head, len(now) - tail))
        else:
            rewrites = True
            out.append((len(before), len(now), len(before), len(now)))
        before = now
    return out, before, rewrites


def _common(a: str, b: str, at: int) -> int:
    """Length of the common start, found by halving."""
    lo, hi = at, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def render(conversations: DataFrame, template: Template = marked, block: int = BLOCK, lead: int = LEAD) -> DataFrame:
    """conv_id, block, n_turns, formatted, turn_spans (start, stop, text_start, text_stop of each turn in formatted, role), rewrites_history.

    One row for each block of turns; the texts of a conversation's blocks, joined in order, are its whole formatted text.
    """
    rows = conversations.select(
        "conv_id", F.coalesce(F.concat(F.lit("0"), F.col("conv_id").cast("string")), F.lit("1")).alias("_conv"),
        F.col("turn").alias("_turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    placed = ranked(rows, "_conv", ["_turn", "role", "text"])
    # each turn goes to its block, the last ones of a block also lead the next, and the first ones of a block also end the one before
    own = F.expr(f"rank div {block}")
    at = placed.withColumn("_b", F.explode(F.array_distinct(F.array(own, F.expr(f"(rank + {lead}) div {block}"), F.expr(f"greatest(0, rank - {lead}) div {block}")))))
    at = at.filter(f"_b = 0 or _b * {block} < group_rows")
    keys = ["_conv", "_b", "rank"]
    dealt = at.repartition(parts(at), "_conv", "_b").sortWithinPartitions(*keys).select("conv_id", "_conv", "_b", "rank", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group: list[dict]) -> dict:
            b = group[0]["_b"]
            lo, hi = b * block, (b + 1) * block
            before = [(x["role"], x["text"]) for x in group if x["rank"] < lo]
            mine = [(x["role"], x["text"]) for x in group if lo <= x["rank"] < hi]
            after = [(x["role"], x["text"]) for x in group if x["rank"] >= hi]
            found, whole, rewrites = spans(before + mine, template, len(before))
            start = found[0][0] if found else len(whole)
            text = whole[start:]
            # the turns after the block, once as its continuation and once as the next block sees them
            if after:
                near = mine[-lead:]
                far = template([*before, *mine, *after])
                close = template([*near, *after])
                rewrites |= not far.startswith(whole) or far[len(whole) :] != close[len(template(near)) :]
            return {"conv_id": group[0]["conv_id"], "_conv": group[0]["_conv"], "block": b, "n_turns": len(mine), "formatted": text,
                    "turn_spans": [{"start": s - start, "stop": e - start, "text_start": i - start, "text_stop": j - start, "role": r} for (s, e, i, j), (r, _) in zip(found, mine, strict=True)],
                    "rewrites_history": rewrites}

        group: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if group and (row["_conv"], row["_b"]) != (group[0]["_conv"], group[0]["_b"]):
                    out.append(done(group))
                    group = []
                group.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if group:
            yield pa.RecordBatch.from_pylist([done(group)], schema)

    span = pa.struct([(c, pa.int64()) for c in ("start", "stop", "text_start", "text_stop")] + [("role", pa.string())])
    schema = pa.schema([("conv_id", pa.int64()), ("_conv", pa.string()), ("block", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("turn_spans", pa.list_(span)), ("rewrites_history", pa.bool_())])
    return dealt.mapInArrow(run, "conv_id long, _conv string, block long, n_turns long, formatted string, turn_spans array<struct<start: long, stop: long, text_start: long, text_stop: long, role: string>>, rewrites_history boolean")


def digests(rendered: DataFrame) -> DataFrame:
    """What reads back from render() with the marked template, one row a conversation.

    The digest of a conversation's whole text must see its blocks in order; they
    stream through one task, which keeps no more than one of them.
    """
    keys = ["_conv", "block"]
    dealt = rendered.repartition(parts(rendered), "_conv").sortWithinPartitions(*keys)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None

        def end(state) -> list:
            conv, n, turns, chars, loss, size, rewrites = state
            return [conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, rewrites]

        schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()], strict=True)))
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["_conv"] != last:
                    if state:
                        out.append(end(state))
                    last, state = row["_conv"], [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                for role, text in read_back(row["formatted"]):
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    state[1] += 1
                for s in row["turn_spans"]:
                    if s["role"] == "assistant":
                        text = unescape(row["formatted"][s["text_start"] : s["text_stop"]])
                        state[3] += len(text)
                        state[4].update(text.encode("utf-8", "surrogatepass"))
                state[5] += len(row["formatted"])
                state[6] |= row["rewrites_history"]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema)
        if state:
            yield pa.RecordBatch.from_pylist([dict(zip(names, end(state), strict=True))], schema)

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")

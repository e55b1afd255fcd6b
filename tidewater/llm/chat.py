"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. The formatter knows
nothing about it: it renders successive turn prefixes, compares each output with the one before and
takes what was added as the span of the new turn. An output that does not start with the one before
is a template that rewrites history, and is reported as such.

With the default template, or one that the caller declares local by naming a stretch, a long
conversation is cut into stretches; any other template is rendered on whole prefixes. Each stretch is rendered behind the
turn before it, so its spans come from prefixes of at most one turn more and no task renders
all prefixes of all turns. This equals rendering whole prefixes for templates in which a turn's
text depends on the turn itself, the one before and whether it is the first. The formatter tests
that at each stretch's start against a longer lead and raises for a template that fails the test.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Template = Callable[[list[tuple[str, str]]], str]

START, END = "<|im_start|>", "<|im_end|>"
STRETCH = 32
_ESCAPES = {"\\": "\\\\", "<|": "<\\|"}
_ESCAPE = re.compile(r"\\|<\|")
_PLAIN = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """No control string is left in the result; unescape() gives the text back."""
    return _ESCAPE.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _PLAIN.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def template(turns: list[tuple[str, str]]) -> str:
    """The default template: marked turns, control strings in roles and texts escaped."""
    return "".join(f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{END}\n" for role, text in turns)


class RewritesHistory(ValueError):
    """The template changes what it has written for earlier turns."""


def spans(render: Template, turns: list[tuple[str, str]], lead: int = 0) -> tuple[str, list[tuple[int, int]]]:
    """What the turns after the first ``lead`` add to the output, and the span of each in that string."""
    before = render(turns[:lead]) if lead else ""
    start, found = len(before), []
    for k in range(lead, len(turns)):
        now = render(turns[: k + 1])
        if not now.startswith(before):
            raise RewritesHistory(f"turn {k} changes the output of the turns before it")
        found.append((len(before) - start, len(now) - start))
        before = now
    return before[start:], found


def content_span(render: Template, turns: list[tuple[str, str]], at: tuple[int, int], added: str) -> tuple[int, int]:
    """Where the text of the last turn stands within its span: the part that changes with the text alone.

    Two probe texts that share no character with each other stand in for the text; what the two
    outputs have in common before and behind is the turn's frame.
    """
    one, two = (render([*turns[:-1], (turns[-1][0], probe)]) for probe in ("\ue000", "\ue001"))
    skip = len(one) - len(two)
    if skip:
        raise RewritesHistory("the frame of a turn depends on its text")
    whole = len(render(turns[:-1])) if len(turns) > 1 else 0
    head = next((i for i, (a, b) in enumerate(zip(one, two, strict=True)) if a != b), len(one)) - whole
    tail = next((i for i, (a, b) in enumerate(zip(reversed(one), reversed(two), strict=True)) if a != b), 0)
    return at[0] + head, at[1] - tail


def format_turns(conversations: DataFrame, render: Template = template, loss_role: str = "assistant", stretch: int | None = None) -> DataFrame:
    """Per stretch of a conversation: conv_id, stretch, turns, formatted, turn_spans, loss_spans (in formatted).

    Rows stand by turn; equal turns by role, then text; null turns first. A null text or role counts
    as empty; rows with a null conv_id make up one conversation. Extra columns are ignored. A ``stretch``
    declares the template local; without one, only the default template's conversations are cut.
    """
    whole = stretch is None and render is not template
    stretch = stretch or (1 << 40 if whole else STRETCH)
    source = conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # Row numbers and the two rows before are what a stretch needs of its conversation; a window keeps no group in memory for them.
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = source.select(
        "*",
        (F.row_number().over(w) - 1).alias("at"),
        F.when((F.row_number().over(w) - 1) % stretch == 0, F.array(*[F.struct(F.lag("role", k).over(w).alias("role"), F.lag("text", k).over(w).alias("text")) for k in (2, 1)])).alias("lead"),
    ).withColumn("stretch", F.floor(F.col("at") / stretch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stretches() -> Iterator[tuple]:
            rows = (r for b in batches for r in b.to_pylist())
            yield from ((key, list(some)) for key, some in groupby(rows, key=lambda r: (r["conv_id"], r["stretch"])))

        out: list[tuple] = []
        size = 0
        for (conv, number), rows in stretches():
            rows = [r for r in rows]
            lead = [(x["role"], x["text"]) for x in rows[0]["lead"] or [] if x["role"] is not None]
            turns = [(r["role"], r["text"]) for r in rows]
            near = lead[-1:]
            text, found = spans(render, near + turns, len(near))
            if len(lead) == 2 and spans(render, [*lead, turns[0]], 2)[0] != text[: found[0][1]]:
                raise RewritesHistory("a turn's output depends on more than the turn before it; use a longer stretch")
            loss = []
            for k, (role, _) in enumerate(turns):
                if role == loss_role:
                    before = turns[:k] if whole else turns[k - 1 : k] if k else near
                    loss.append(content_span(render, [*before, turns[k]], found[k], text))
            out.append((conv, number, len(turns), text, [{"a": a, "b": b} for a, b in found], [{"a": a, "b": b} for a, b in loss]))
            size += len(text)
            if len(out) >= 2000 or size > 8_000_000:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    # All rows of a stretch meet in one task; a conversation of many turns is spread over its stretches.
    return (
        rows.repartition("conv_id", "stretch")
        .sortWithinPartitions("conv_id", "stretch", "at")
        .select("conv_id", "stretch", "at", "role", "text", "lead")
        .mapInArrow(run, "conv_id long, stretch long, n_turns long, formatted string, turn_spans array<struct<a: long, b: long>>, loss_spans array<struct<a: long, b: long>>")
    )


_SPAN = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv_id": pa.int64(), "stretch": pa.int64(), "n_turns": pa.int64(), "formatted": pa.string(), "turn_spans": _SPAN, "loss_spans": _SPAN}
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text and its spans alone: turns, digests and lengths.

    Digests run over a conversation's stretches in order, with one stretch in memory at a time.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                text, turns = r["formatted"], []
                for s in r["turn_spans"]:
                    m = _TURN.fullmatch(text, s["a"], s["b"])
                    if not m:
                        raise ValueError("a turn's span does not hold one whole turn")
                    turns.append(f"{unescape(m[1])}\n{unescape(m[2])}\n")
                loss = "".join(unescape(text[s["a"] : s["b"]]) for s in r["loss_spans"])
                out.append((r["conv_id"], r["stretch"], len(turns), "".join(turns).encode(), len(loss), loss.encode(), len(text)))
            if out:
                kinds = {"conv_id": pa.int64(), "stretch": pa.int64(), "n_turns": pa.int64(), "turns": pa.binary(), "loss_chars": pa.int64(), "loss": pa.binary(), "chars": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        rows = (r for b in batches for r in b.to_pylist())
        out = []
        for conv, some in groupby(rows, key=lambda r: r["conv_id"]):
            a, b, n, m, k = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for r in some:
                a.update(r["turns"])
                b.update(r["loss"])
                n, m, k = n + r["n_turns"], m + r["loss_chars"], k + r["chars"]
            out.append((conv, n, a.hexdigest(), m, b.hexdigest(), k))
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    parsed = formatted.mapInArrow(parse, "conv_id long, stretch long, n_turns long, turns binary, loss_chars long, loss binary, chars long")
    return (
        parsed.repartition("conv_id")
        .sortWithinPartitions("conv_id", "stretch")
        .mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )

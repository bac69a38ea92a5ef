"""Chat formatting by incremental rendering of a black-box template.

The renderer sees a template only as ``render(turns, opening)``. For each turn it
renders the prefix that ends there, compares it with the prefix before (their common
start is settled output; the rest is the turn's span), and finds the turn's text
inside the span by rendering two one-character probes in its place: where the probes'
outputs first differ the text starts, and what follows a probe is the turn's trailer.
Where new output does not start with the old one, the template rewrote history: the
conversation is flagged (``rewrote``) and has no spans and no digests.

Any template gets true prefixes: every turn is rendered after all turns before it, so a
conversation is held as a whole and its work grows with the square of its turns. Two kinds
of templates are rendered in runs of ``RUN`` turns instead:

* An ``Appending`` template is made of a function of one turn. It cannot see another turn,
  so it only appends (the rendering of two lists of turns in a row is that of the first and
  then, without the opening, that of the second). Rows stream, and a conversation of any
  length needs the memory of one run. The built-in template is one.
* Any other template may declare that it only appends (``additive``). The declaration is
  checked on every conversation, whatever its size: each run against its rendering together
  with the run before, and all runs against one rendering of all turns. So a conversation is
  held as a whole here, too; one that breaks the declaration is flagged.

Defined cases: null text is empty; a null role is rendered as ``null``; turns with equal
or null numbers are ordered by role, then text; repeated rows are turns of their own;
rows with a null conv_id form one conversation; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.jobs import spread

#: Turns of a run under a template that only appends.
RUN = 16

Turn = tuple[str, str]
Template = Callable[[list[Turn], bool], str]

#: Control strings of the built-in template (fixed values).
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[OUT]")
_control = re.compile("|".join(re.escape(c) for c in CONTROL) + r"|\\")
_escaped = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Break control strings with a backslash after their first character; double backslashes."""
    return _control.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


class Appending:
    """A template made of an opening and a function of one turn (its role and text): it only appends."""

    def __init__(self, opening: str, turn: Callable[[str, str], str]) -> None:
        self.opening, self.turn = opening, turn

    def __call__(self, turns: list[Turn], opening: bool) -> str:
        return "".join([self.opening if opening else "", *(self.turn(role, text) for role, text in turns)])


def instruct_turn(role: str, text: str) -> str:
    """Instruction marks for users, an output mark and an end for assistants."""
    t = escape(text)
    if role == "user":
        return f"[INST]{t}[/INST]"
    if role == "assistant":
        return f"[OUT]{t}</s>"
    if role == "system":
        return f"[SYS]{t}[/SYS]"
    return f"[ROLE]{escape(role).replace(chr(10), chr(92) + chr(10))}\n{t}[/ROLE]"


#: The built-in template.
instruct = Appending("<s>", instruct_turn)

#: What the built-in template's output reads back as.
_TURN = re.compile(r"\[INST\](?P<user>.*?)\[/INST\]|\[OUT\](?P<assistant>.*?)</s>|\[SYS\](?P<system>.*?)\[/SYS\]|\[ROLE\](?P<role>(?:\\.|[^\\\n])*)\n(?P<other>.*?)\[/ROLE\]", re.DOTALL)


def read_back(output: str) -> list[Turn]:
    """Turns of an output of the built-in template."""
    turns = []
    for m in _TURN.finditer(output.removeprefix("<s>")):
        if m["other"] is not None:
            turns.append((unescape(m["role"]), unescape(m["other"])))
        else:
            turns.append((m.lastgroup, unescape(m[m.lastgroup])))
    return turns


def common(a: str, b: str) -> int:
    """Length of the common start of two strings."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


class Run:
    """A growing prefix of turns and the spans found in its output."""

    def __init__(self, template: Template, opening: bool) -> None:
        self.template, self.opening, self.turns = template, opening, []
        self.output, self.spans, self.rewrote = template([], opening), [], False

    def add(self, role: str, text: str) -> None:
        new = self.template([*self.turns, (role, text)], self.opening)
        start = common(self.output, new)
        self.rewrote |= start < len(self.output)
        one, two = (self.template([*self.turns, (role, c)], self.opening) for c in "\ue000\ue001")
        head = common(one, two)
        self.spans.append((role, start, head, len(new) - (len(one) - head - 1), len(new)))
        self.turns.append((role, text))
        self.output = new


def rendered(template: Template, turns: list[Turn], opening: bool) -> Run:
    """A run of all these turns."""
    run = Run(template, opening)
    for role, text in turns:
        run.add(role, text)
    return run


def appended(template: Template, parts: list[Run]) -> bool:
    """Do a conversation's runs, in pairs and all together, equal what the template makes of their turns at once?"""
    if not all(template([*a.turns, *b.turns], a.opening) == a.output + b.output for a, b in pairwise(parts)):
        return False
    return template([t for p in parts for t in p.turns], True) == "".join(p.output for p in parts)


_OUT = "conv_id long, run long, turns array<struct<role:string,start:int,text_start:int,text_end:int,end:int>>, output string, rewrote boolean, last boolean"


def ordered(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation together, in order; sorting spills, nothing is gathered."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("null")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return spread(rows, None, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def runs(rows: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[int | None, int, list[Turn], bool]]:
    """(conversation, run number, turns, last run?) over rows sorted by conversation; runs have at most so many turns."""
    now: object = ...
    number, held = 0, []
    for batch in rows:
        for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if now is ... or conv != now:
                if now is not ...:
                    yield now, number, held, True
                now, number, held = conv, 0, []
            elif len(held) == most:
                yield now, number, held, False
                number, held = number + 1, []
            held.append((role, text))
    if now is not ...:
        yield now, number, held, True


def render(conversations: DataFrame, template: Template = instruct, additive: bool | None = None) -> DataFrame:
    """Rendered conversations with the spans of their turns, in one row each, or in runs if the template only appends.

    ``start..end`` is a turn's span in its row's output, ``text_start..text_end`` its text; there are none
    where the template rewrote history or broke its declaration. ``additive`` is by default what the template itself declares;
    False asks for true prefixes of an ``Appending`` template, too.
    """
    streams = type(template) is Appending and additive is not False
    declared = not streams and (getattr(template, "additive", False) if additive is None else additive)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, number, turns, last in runs(batches, RUN if streams else None):
            step = RUN if declared else len(turns)
            parts = [rendered(template, turns[i : i + step], number == i == 0) for i in range(0, len(turns), step)]
            rewrote = any(p.rewrote for p in parts) or (declared and not appended(template, parts))
            for i, p in enumerate(parts):
                spans = [] if rewrote else [dict(zip(("role", "start", "text_start", "text_end", "end"), s, strict=True)) for s in p.spans]
                out.append({"conv_id": conv, "run": number + i, "output": p.output, "rewrote": rewrote, "last": last and p is parts[-1], "turns": spans})
                size += len(p.output)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(_OUT))
    return ordered(conversations).mapInArrow(run, _OUT)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrote boolean"


def digests(rendered: DataFrame) -> DataFrame:
    """Per conversation, read back from rendered runs: turns, text under the loss mask, size; nulls where history was rewritten.

    Rendering leaves a conversation's runs together and in order, so this pass has no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
        state = fresh()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for role, text in read_back(r["output"]):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for s in r["turns"]:
                    if s["role"] == "assistant":
                        text = unescape(r["output"][s["text_start"] : s["text_end"]])
                        state[2] += len(text)
                        state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(r["output"])
                state[5] |= r["rewrote"]
                if r["last"]:
                    read = (state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
                    out.append((r["conv_id"], *((None,) * 5 if state[5] else read), state[5]))
                    state = fresh()
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _DIGEST.split(", ")])

    return rendered.mapInArrow(run, _DIGEST)


def token_mask(output: str, spans: list[tuple[str, int, int, int, int]]) -> np.ndarray:
    """Boolean mask over an output's characters: the assistant texts."""
    mask = np.zeros(len(output), bool)
    for role, _, a, b, _ in spans:
        if role == "assistant":
            mask[a:b] = True
    return mask

"""Chat formatting with incremental black-box rendering.

A template is any function from a list of ``(role, text)`` to a string. Nothing is
known of it: successive turn prefixes are rendered and consecutive outputs compared.
What the longer output adds is the new turn's span; a longer output that doesn't begin
with the shorter one shows that the template rewrites history, and the conversation is
reported with ``error`` instead of spans. The text inside a turn's span is found by
rendering the turn once more with a probe in the text's place.

Defined results: a null text or role is empty; turns are ordered by turn number, null
first, then role and text, so repeated rows are turns of their own; rows with a null
conv_id are one conversation; whole texts are rendered, however long; no rows give no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

#: A text that no template writes itself.
PROBE = "\U000f5c3a"

#: Texts without any of these need no escape; to search for them is much faster than the patterns.
_MARKS = ("\\", "### ", "</turn>")
_CONTROL = re.compile(r"(\\)|(?=### |</turn>)")
_ROLE_CONTROL = re.compile(r"(\\|:)|(?=### |</turn>)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """A backslash before each backslash and each place where a control string begins."""
    if not any(mark in text for mark in _MARKS):
        return text
    return _CONTROL.sub(lambda m: "\\" + (m[1] or ""), text)


def escape_role(role: str) -> str:
    """As ``escape``, and before each colon, which ends a role."""
    if ":" not in role and not any(mark in role for mark in _MARKS):
        return role
    return _ROLE_CONTROL.sub(lambda m: "\\" + (m[1] or ""), role)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def marked_turns(turns: Turns) -> str:
    """``### role: text</turn>`` and a line feed for each turn; control strings inside are escaped."""
    return "".join(f"### {escape_role(role)}: {escape(text)}</turn>\n" for role, text in turns)


class Span(NamedTuple):
    role: str
    start: int
    end: int
    text_start: int
    text_end: int


class TemplateError(ValueError):
    pass


class Incremental:
    """Renders a conversation turn by turn and keeps each turn's span (in code points).

    Every prefix is rendered whole. With a ``window``, a turn is rendered with that many
    to twice as many turns before it, and ``text`` compares the parts with the template's
    output for the whole conversation: rewriting that the last output doesn't show stays
    unseen, so this is for templates known to render turn by turn.
    """

    def __init__(self, template: Template, window: int | None = None):
        self.template, self.window = template, window
        self.turns: Turns = []
        self.last, self.size, self.parts, self.spans = template([]), 0, [], []
        self.parts.append(self.last)
        self.size = len(self.last)
        self.cut: Turns = []

    def add(self, role: str, text: str) -> None:
        if self.window is not None and len(self.turns) >= 2 * self.window:
            n = len(self.turns) - self.window
            self.cut += self.turns[:n]
            del self.turns[:n]
            self.last = self.template(self.turns)
        out = self.template([*self.turns, (role, text)])
        if not out.startswith(self.last):
            raise TemplateError(f"turn {len(self.spans)} rewrites what came before it")
        probed = self.template([*self.turns, (role, PROBE)])
        before = probed.find(PROBE, len(self.last))
        after = len(probed) - before - len(PROBE)
        if before < 0 or before + after > len(out) or out[:before] != probed[:before] or out[len(out) - after :] != probed[len(probed) - after :]:
            raise TemplateError(f"turn {len(self.spans)} doesn't hold its text in one place")
        shift = self.size - len(self.last)
        self.spans.append(Span(role, self.size, shift + len(out), shift + before, shift + len(out) - after))
        self.parts.append(out[len(self.last) :])
        self.size = shift + len(out)
        self.turns.append((role, text))
        self.last = out

    def text(self) -> str:
        whole = "".join(self.parts)
        if self.cut and whole != self.template([*self.cut, *self.turns]):
            raise TemplateError("the parts differ from the whole conversation")
        return whole


SPANS = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_())]))
SCHEMA = "conv_id long, formatted string, spans array<struct<role:string,start:long,end:long,text_start:long,text_end:long,loss:boolean>>, error string"


def format_conversations(conversations: DataFrame, template: Template = marked_turns, loss_roles: tuple[str, ...] = ("assistant",), window: int | None = None) -> DataFrame:
    """One row ``SCHEMA`` for each conversation; ``loss`` marks the spans that are trained on.

    One shuffle by conv_id; each task streams its sorted rows with one conversation in
    memory. Every prefix is rendered whole, so a conversation costs the square of its
    turns; a ``window`` bounds that, see ``Incremental``.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, key, state, error, begun = 0, None, None, None, False

        def close() -> None:
            nonlocal size, error
            if error is None:
                try:
                    whole = state.text()
                except TemplateError as e:
                    error = str(e)
            if error is None:
                spans = [s._asdict() | {"loss": s.role in loss_roles} for s in state.spans]
                held.append((key, whole, spans, None))
                size += state.size
            else:
                held.append((key, None, None, error))

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), SPANS, pa.string()), strict=True)], names=["conv_id", "formatted", "spans", "error"])

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not begun or conv_id != key:
                    if begun:
                        close()
                        if len(held) >= 1024 or size > 1 << 24:
                            yield batch_of()
                            held, size = [], 0
                    key, state, error, begun = conv_id, Incremental(template, window), None, True
                if error is None:
                    try:
                        state.add(role or "", text or "")
                    except TemplateError as e:
                        error, state = str(e), None
        if begun:
            close()
            yield batch_of()

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", "turn")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(render, SCHEMA)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame, unescape_text: Callable[[str], str] = unescape) -> DataFrame:
    """What the stored strings and spans hold: ``DIGESTS`` of each conversation without error."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, whole, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                turns, loss, n = hashlib.sha256(), hashlib.sha256(), 0
                for s in spans:
                    text = unescape_text(whole[s["text_start"] : s["text_end"]])
                    turns.update(f"{s['role']}\n{text}\n".encode())
                    if s["loss"]:
                        loss.update(text.encode())
                        n += len(text)
                rows.append((conv_id, len(spans), turns.hexdigest(), n, loss.hexdigest(), len(whole)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return formatted.where("error is null").select("conv_id", "formatted", "spans").mapInArrow(digest, DIGESTS)

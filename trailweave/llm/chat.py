"""Chat formatting: a finite-state machine over roles, a declarative template, loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.cluster import shipped


@dataclass(frozen=True)
class Template:
    """Marks of a turn, names of roles, and which roles are learned from.

    A turn is ``open + name + sep + text + close``. A role without a name is written as ``=role``.
    """

    open: str = "### "
    sep: str = ": "
    close: str = "</turn>\n"
    escape: str = "\\"
    names: tuple[tuple[str, str], ...] = (("system", "System"), ("user", "User"), ("assistant", "Assistant"))
    loss: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state
    turns: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "ready"), ("start", "user", "asked"), ("ready", "user", "asked"),
        ("asked", "assistant", "answered"), ("answered", "user", "asked"),
    )
    accept: tuple[str, ...] = ("answered",)


class Formatter:
    """Writes and reads back conversations by one template."""

    def __init__(self, template: Template = Template()):
        self.template = t = template
        self.controls = sorted({t.escape, t.open.strip(), t.close.strip(), *(f"{t.open}{n}{t.sep}".strip() for _, n in t.names)}, key=lambda c: (-len(c), c))
        either = "|".join(map(re.escape, self.controls))
        self._hide, self._show = re.compile(either), re.compile(f"{re.escape(t.escape)}({either}|{re.escape(t.sep)})")
        self._token = re.compile(f"{re.escape(t.escape)}(?:{either}|{re.escape(t.sep)})|({re.escape(t.close)})")
        self._head = re.compile(f"{re.escape(t.escape)}(?:{either}|{re.escape(t.sep)})|({re.escape(t.sep)})")
        self._name, self._role = dict(t.names), {n: r for r, n in t.names}
        self._next = {(s, r): n for s, r, n in t.turns}

    def hidden(self, text: str) -> str:
        """``text`` with the escape sign before every control string, itself included."""
        return self._hide.sub(lambda m: self.template.escape + m[0], text)

    def shown(self, text: str) -> str:
        return self._show.sub(lambda m: m[1], text)

    def named(self, role: str) -> str:
        if role in self._name:
            return self._name[role]
        t = self.template
        return "=" + self.hidden(role).replace(t.sep, t.escape + t.sep)

    def check(self, roles: Iterable[str]) -> str:
        """'' if the order of roles is accepted, else what is wrong and at which turn."""
        state, n = "start", 0
        for role in roles:
            if (state, role) not in self._next:
                return f"turn {n}: {role or 'no role'} after {state}"
            state, n = self._next[state, role], n + 1
        return "" if state in self.template.accept else f"ends as {state}"

    def segments(self, turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, bool]]:
        """Text segments in order, each with its loss flag: head, text and close of every turn."""
        t = self.template
        for role, text in turns:
            yield t.open + self.named(role) + t.sep, False
            yield self.hidden(text), role in t.loss
            yield t.close, False

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns again; ValueError if the text was not written by this template."""
        t, at, out = self.template, 0, []
        while at < len(formatted):
            if not formatted.startswith(t.open, at):
                raise ValueError(f"no turn at {at}")
            at += len(t.open)
            head = next((m for m in self._head.finditer(formatted, at) if m[1]), None)
            name = formatted[at : head.start()] if head else ""
            if not head or not (name.startswith("=") or name in self._role):
                raise ValueError(f"no role at {at}")
            role = self.shown(name[1:]) if name.startswith("=") else self._role[name]
            end = next((m for m in self._token.finditer(formatted, head.end()) if m[1]), None)
            if not end:
                raise ValueError(f"no end of the turn at {at}")
            out.append((role, self.shown(formatted[head.end() : end.start()])))
            at = end.end()
        return out


SCHEMA = "conv_id bigint, formatted string, loss_spans array<struct<start:bigint,end:bigint>>, error string"
_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("error", pa.string())]
)


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id, formatted, loss_spans, error`` for every conversation.

    Spans are code points of ``formatted``, end exclusive, one for each learned text, empty ones
    too. ``error`` is '' if the role machine accepts the turns; a rejected conversation is
    formatted all the same. Turns go by turn (null first), then role, then text; a null text or
    role is ''. Rows with a null conv_id are one conversation. Rows are dealt by conversation,
    sorted by Spark and streamed, so a worker holds one conversation at a time.
    """
    shipped(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def formatted(batches):
        form, key, turns, none = Formatter(template), None, [], True

        def done():
            at, parts, spans = 0, [], []
            for text, loss in form.segments(turns):
                if loss:
                    spans.append({"start": at, "end": at + len(text)})
                parts.append(text)
                at += len(text)
            return key, "".join(parts), spans, form.check(r for r, _ in turns)

        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if none or conv != key:
                    if not none:
                        out.append(done())
                    key, turns, none = conv, [], False
                turns.append((role, text))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, _ARROW, strict=True)], schema=_ARROW)
        if not none:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(done(), _ARROW, strict=True)], schema=_ARROW)

    return rows.mapInArrow(formatted, SCHEMA)


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of what ``format_conversations`` wrote, all taken from its output."""
    shipped(formatted.sparkSession)
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"

    def read(batches):
        form = Formatter(template)
        for batch in batches:
            out = []
            for conv, text, spans, error in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans", "error")), strict=True):
                turns = form.read(text)
                said = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode())
                learned = "".join(form.shown(text[s["start"] : s["end"]]) for s in spans)
                out.append((conv, len(turns), said.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text), not error))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return formatted.mapInArrow(read, schema)

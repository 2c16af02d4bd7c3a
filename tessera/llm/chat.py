"""Chat formatting by a declarative template.

A finite-state machine over roles checks the order of turns; each turn becomes segments
(text, loss flag) after the template's entry for its role. Control strings inside texts are
escaped by quote-stuffing: one more escape character goes behind the control string's first
character, and reading back takes one away, so any text survives.

A conversation is the rows of one conv_id (nulls form one), by turn, then role, then text,
nulls first; repeated rows are turns of their own. A null role reads as '', null text as ''.
Roles the template lacks are formatted by its `other` entry and never fit the order. Rows
stream through the tasks in order with constant state, so a conversation of any length
needs no memory. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = {
    "escape": "\\",
    "roles": {
        "system": {"open": "<<SYS>>", "close": "<</SYS>>", "loss": False},
        "user": {"open": "[INST]", "close": "[/INST]", "loss": False},
        "assistant": {"open": "<s>", "close": "</s>", "loss": True},
    },
    "other": {"open": "[ROLE]", "name_close": "[/ROLE]", "close": "[END]", "loss": False},
    "start": "start",
    "next": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
}
SEGMENTS = "array<struct<text:string,loss:boolean>>"


class Formatter:
    """One template's escapes, segments, order of turns and reading back."""

    def __init__(self, template: dict = TEMPLATE):
        self.roles, self.other, self.order, self.start = template["roles"], template["other"], template["next"], template["start"]
        esc = template["escape"]
        entries = [*self.roles.values(), self.other]
        controls = sorted({v for e in entries for k, v in e.items() if k != "loss"}, key=len, reverse=True)
        spelled = [(re.escape(c[0]), re.escape(c[1:])) for c in controls]
        stuffed = re.escape(esc)
        self._raw = re.compile("|".join(f"{a}{stuffed}*{b}" for a, b in spelled), re.S)
        self._escaped = re.compile("|".join(f"{a}{stuffed}+{b}" for a, b in spelled), re.S)
        self._esc = esc
        q = re.escape
        turns = [f"{q(e['open'])}(?P<r{i}>.*?){q(e['close'])}" for i, e in enumerate(self.roles.values())]
        o = self.other
        turns.append(f"{q(o['open'])}(?P<name>.*?){q(o['name_close'])}(?P<body>.*?){q(o['close'])}")
        self._turn = re.compile("|".join(turns), re.S)
        self._names = list(self.roles)

    def escape(self, text: str) -> str:
        return self._raw.sub(lambda m: m[0][0] + self._esc + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0][0] + m[0][2:], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        e = self.roles.get(role)
        if e is None:
            o = self.other
            return [(o["open"] + self.escape(role) + o["name_close"], False), (self.escape(text), o["loss"]), (o["close"], False)]
        return [(e["open"], False), (self.escape(text), e["loss"]), (e["close"], False)]

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """The state after a turn, and whether the turn may come here; after a wrong turn the order starts from that role."""
        return (role if role in self.roles else self.start), role in self.order.get(state, ())

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of a formatted string."""
        turns = []
        for m in self._turn.finditer(formatted):
            if m["name"] is not None:
                turns.append((self.unescape(m["name"]), self.unescape(m["body"])))
            else:
                k = next(i for i in range(len(self._names)) if m[f"r{i}"] is not None)
                turns.append((self._names[k], self.unescape(m[f"r{k}"])))
        return turns


def format_chat(conversations: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, turn, segments, valid: one row a turn, in order inside each partition; a conversation lies in one."""
    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Formatter(template)
        last, state, first = None, f.start, True
        kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        for b in batches:
            out, valid = [], []
            for conv, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                if first or conv != last:
                    first, last, state = False, conv, f.start
                state, fits = f.step(state, role or "")
                valid.append(fits)
                out.append([{"text": t, "loss": x} for t, x in f.segments(role or "", text or "")])
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(out, kind), pa.array(valid, pa.bool_())], names=["conv_id", "turn", "segments", "valid"])

    return rows.mapInArrow(run, f"conv_id {_type(conversations, 'conv_id')}, turn {_type(conversations, 'turn')}, segments {SEGMENTS}, valid boolean")


def read_back(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row a conversation, from format_chat's output alone: digests of turns and of the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Formatter(template)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_invalid"]
        last, now = None, None
        for b in batches:
            done = []
            for conv, segments, valid in zip(b.column("conv_id").to_pylist(), b.column("segments").to_pylist(), b.column("valid").to_pylist(), strict=True):
                if now is None or conv != last:
                    if now is not None:
                        done.append(_closed(last, now))
                    last, now = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in f.read("".join(s["text"] for s in segments)):
                    now[0] += 1
                    now[1].update(f"{role}\n{text}\n".encode())
                for s in segments:
                    if s["loss"]:
                        plain = f.unescape(s["text"])
                        now[2] += len(plain)
                        now[3].update(plain.encode())
                    now[4] += len(s["text"])
                now[5] += not valid
            if done:
                yield _rows(done, names, b.schema.field("conv_id").type)
            kind = b.schema.field("conv_id").type
        if now is not None:
            yield _rows([_closed(last, now)], names, kind)

    return formatted.mapInArrow(run, f"conv_id {_type(formatted, 'conv_id')}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_invalid bigint")


def _closed(conv, now: list) -> tuple:
    return conv, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4], now[5]


def _rows(done: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table plus conversation -1, whose texts are made of control strings."""
    probe = conversations.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)

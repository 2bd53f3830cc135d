"""Lossless clean-up of conversations.

Empty answers go, empty and repeated tool results go together with the calls
that asked for them, and neighbouring answers of pure text become one.  Whether
a result repeats depends on what has been kept so far, so the exact pass walks
each conversation in order.  The walk sees no text, only what decides: kinds,
ids, sizes, and SHA-256 of inputs and results.  `drop_empty`, `merged_islands`
and `repeated_calls` are the parts that windows can express, for inputs where
they apply.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank, u16len
from ..shared import once
from .region import TAIL, bounds, chars, part_text

SUMMARY_MARK = "[condensed-chat]"
_WS = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_TEXTS = ("text", "error-text", "json", "content", "error-json")


class Part(NamedTuple):
    """What decides about a part: `same` stands for a call's input or a result's text."""

    at: int
    type: str | None
    call_id: str | None
    tool: str | None
    same: str | None
    units: int
    blank: bool


@dataclass
class Shape:
    """What decides about a message; `blank` is that of its text where it has no parts, `at` the positions it is made of."""

    at: list[int]
    role: str | None
    split: bool
    summary: bool
    size: int
    blank: bool
    parts: list[Part]
    place: int = -1

    def of(self, kind: str) -> list[Part]:
        return [p for p in self.parts if p.type == kind]

    @property
    def is_text(self) -> bool:
        return not self.split or all(p.type == "text" for p in self.parts)


def edges_of(roles: list[str | None], protected: int) -> tuple[int, int]:
    """As region.edges(), of the roles of messages in order."""
    users = [i for i, r in enumerate(roles) if r == "user"]
    if not users:
        return 0, 0
    end = users[-protected] if len(users) >= protected else len(roles) - TAIL
    return users[0] + 1, max(end, users[0] + 1)


class Walk:
    """The pass over one conversation; `kept` is what remains so far, `calls` finds the messages that hold a call."""

    def __init__(self):
        self.kept: list[Shape] = []
        self.calls: dict[str, list[Shape]] = {}
        self.removed = 0

    def keep(self, m: Shape) -> None:
        m.place = len(self.kept)
        self.kept.append(m)
        if m.role == "assistant":
            for p in m.of("tool-call"):
                if p.call_id is not None:
                    self.calls.setdefault(p.call_id, []).append(m)

    def holder(self, ids: list[str]) -> Shape | None:
        """The latest kept message with any of the calls."""
        return max((self.calls[i][-1] for i in ids if self.calls.get(i)), key=lambda k: k.place, default=None)

    def tail(self, n: int) -> Shape | None:
        return self.kept[-n] if len(self.kept) >= n else None

    def asked(self, results: list[Part]) -> list[tuple] | None:
        """Tool and input of the calls behind results; None unless one message holds all of them."""
        ids = [p.call_id for p in results if p.call_id is not None]
        k = self.holder(ids)
        found = {p.call_id: (p.tool, p.same) for p in k.of("tool-call") if p.call_id in ids} if k else {}
        return [found[i] for i in ids] if ids and len(found) == len(ids) else None

    def repeats(self, m: Shape) -> bool:
        before = self.tail(1)
        if before and before.role == "assistant":
            before = self.tail(2)
        if not before or before.role != "tool":
            return False
        a, b = before.parts, m.parts
        if not a or [(p.type, p.tool, p.same) for p in a] != [(p.type, p.tool, p.same) for p in b] or any(p.type != "tool-result" for p in a):
            return False
        asked = self.asked(a)
        return asked is not None and asked == self.asked(b)

    def take_out(self, results: list[Part]) -> bool:
        """Remove the calls behind results; only if one message holds them all, else nothing happens."""
        ids = [p.call_id for p in results if p.type == "tool-result" and p.call_id is not None]
        k = self.holder(ids)
        gone = [p for p in k.of("tool-call") if p.call_id in ids] if k else []
        saved = sum(p.units for p in gone) + sum(p.units for p in results)
        if not ids or len(gone) != len(ids) or not saved:
            return False
        for i in set(ids):
            self.calls[i].remove(k)
        k.parts = [p for p in k.parts if p not in gone]
        if not k.parts:
            del self.kept[k.place]
            for later in self.kept[k.place :]:
                later.place -= 1
        self.removed += saved
        return True

    def tool(self, m: Shape) -> None:
        empty = [p for p in m.of("tool-result") if p.blank]
        if empty and self.take_out(empty):
            m.parts = [p for p in m.parts if p not in empty]
            if not m.parts:
                return
        if not (self.repeats(m) and self.take_out(m.parts)):
            self.keep(m)

    def answer(self, m: Shape) -> None:
        last = self.tail(1)
        words = not all(p.blank for p in m.parts) if m.split else not m.blank
        if not m.summary and m.is_text and not words:
            self.removed += m.size
        elif m.is_text and last and last.role == "assistant" and last.is_text and not last.summary:
            last.at = last.at + m.at
            last.summary = False
        else:
            self.keep(m)


def walked(messages: list[Shape], protected: int) -> Walk:
    """The walk over one conversation in order; changes the shapes."""
    start, end = edges_of([m.role for m in messages], protected)
    walk = Walk()
    for i, m in enumerate(messages):
        if start <= i < end and m.role == "tool" and m.split:
            walk.tool(m)
        elif start <= i < end and m.role == "assistant":
            walk.answer(m)
        else:
            walk.keep(m)
    return walk


def skeleton(messages: DataFrame, mark: str) -> DataFrame:
    """A row per part, or per message without any, with the fields of Shape and Part and no text."""
    split = F.coalesce(F.col("kind") == "parts", F.lit(False))
    plain = F.when(F.col("kind") == "string", F.col("text"))
    summary = F.coalesce((F.col("role") == "assistant") & plain.startswith(mark), F.lit(False))
    rows = messages.select("conv_id", "pos", "role", split.alias("split"), summary.alias("summary"), F.coalesce(chars(F.col("kind"), F.col("text"), F.col("parts")), F.lit(0)).alias("size"), blank(plain).alias("plain"), F.posexplode_outer(F.when(split, F.col("parts"))).alias("at", "p"))
    p, said = F.col("p"), part_text(F.col("p"))
    same = F.when(p["type"] == "tool-call", p["input"]).when(p["type"] == "tool-result", said)
    return rows.select("conv_id", "pos", "role", "split", "summary", "size", "plain", "at", p["type"].alias("type"), p["call_id"].alias("call_id"), p["tool"].alias("tool"), F.sha2(same, 256).alias("same"), u16len(said).cast("long").alias("units"), blank(said).alias("blank"))


def _shapes(rows: Iterable[tuple]) -> Iterator[Shape]:
    last = None
    for pos, role, split, summary, size, plain, at, *part in rows:
        if last is None or last.at[0] != pos:
            if last:
                yield last
            last = Shape([pos], role, split, summary, size, plain, [])
        if at is not None:
            last.parts.append(Part(at, *part))
    if last:
        yield last


STATE = "n_before int, chars_before long, structural_removed long, region_start int, region_end int"
_PLAN = pa.schema([("pos", pa.int32()), ("src", pa.int32()), ("left", pa.list_(pa.int32())), ("joins", pa.int32()), ("n_before", pa.int32()), ("chars_before", pa.int64()), ("structural_removed", pa.int64()), ("region_start", pa.int32()), ("region_end", pa.int32())])


def _planned(messages: DataFrame, protected: int, least: int, enabled: bool, mark: str) -> DataFrame:
    """conv_id, new position, source position, kept parts and number of sources of every message that stays, and its conversation's state."""
    rows = skeleton(messages, mark)
    fields = rows.columns[1:]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("pos", "ascending"), ("at", "ascending")])
        shapes = list(_shapes(zip(*(t.column(c).to_pylist() for c in fields))))
        before, total, removed = len(shapes), sum(m.size for m in shapes), 0
        on = enabled and before >= least
        if on:
            walk = walked(shapes, protected)
            shapes, removed = walk.kept, walk.removed
        start, end = edges_of([m.role for m in shapes], protected) if on else (0, 0)
        made = [(i, src, [p.at for p in m.parts] if m.split else None, len(m.at)) for i, m in enumerate(shapes) for src in m.at]
        state = [(before, total, removed, start, end)] * len(made)
        columns = list(zip(*(m + s for m, s in zip(made, state)))) or [()] * len(_PLAN)
        own = pa.array([t.column("conv_id")[0].as_py()] * len(made), t.schema.field("conv_id").type)
        return pa.Table.from_arrays([own, *(pa.array(c, f.type) for c, f in zip(columns, _PLAN))], names=["conv_id", *_PLAN.names])

    return rows.groupBy("conv_id").applyInArrow(run, f"conv_id long, pos int, src int, left array<int>, joins int, {STATE}")


def _words(kind: Column, text: Column, parts: Column) -> Column:
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit("")))
    return F.coalesce(F.when(kind == "string", text).when(kind == "parts", F.array_join(texts, "\n")), F.lit(""))


def structural(messages: DataFrame, protected: int, least: int = 4, enabled: bool = True, mark: str = SUMMARY_MARK) -> DataFrame:
    """Cleaned messages with new positions, and per conversation its sizes before, what went, and the region of the result.

    Conversations of fewer than `least` messages stay as they are and get an
    empty region.  Conversations are independent; each is walked by one task, in
    which a message takes some hundred bytes whatever its texts are.  The walks
    take place here and now, once, and their decisions are written to the shared
    folder; messages are joined with them.  A position names one message of its
    conversation, and is not null.
    """
    plan = once(_planned(messages, protected, least, enabled, mark))
    state = [f.split()[0] for f in STATE.split(", ")]
    columns = ["msg_id", "role", "kind", "text", "parts"]
    m = messages.select(F.col("conv_id").alias("__conv"), F.col("pos").alias("__src"), *columns)

    def held(which: DataFrame) -> DataFrame:
        # decisions are hashed, so texts aren't sorted, and move by message: no conversation is one task's
        return m.join(which.hint("shuffle_hash"), m["__conv"].eqNullSafe(which["conv_id"]) & (m["__src"] == which["src"]))

    pick = F.transform("left", lambda i: F.get("parts", i))
    alone = held(plan.filter("joins = 1")).withColumn("parts", F.when(F.col("left").isNull() | (F.size("left") == F.size("parts")), F.col("parts")).otherwise(pick))
    out = alone.select("conv_id", "pos", *columns, *state)
    several = plan.filter("joins > 1")
    if several.isEmpty():
        return out
    texts = F.sort_array(F.collect_list(F.struct("src", _words(F.col("kind"), F.col("text"), F.col("parts")).alias("words"))))
    joined = held(several).groupBy("conv_id", "pos", *state).agg(F.min_by("msg_id", "src").alias("msg_id"), texts.alias("texts"))
    words = F.array_join(F.filter(F.transform("texts", lambda x: x["words"]), lambda w: w != ""), "\n\n")
    part = {f.name: F.lit(None).cast(f.dataType) for f in messages.schema["parts"].dataType.elementType.fields} | {"type": F.lit("text"), "text": words}
    made = F.array(F.struct(*(c.alias(n) for n, c in part.items()))).cast(messages.schema["parts"].dataType)
    return out.unionByName(joined.select("conv_id", "pos", "msg_id", F.lit("assistant").alias("role"), F.lit("parts").alias("kind"), F.lit(None).cast("string").alias("text"), made.alias("parts"), *state))


def orphans(messages: DataFrame) -> DataFrame:
    """conv_id and call_id of calls without a result; an anti join of the two."""
    p = messages.select("conv_id", F.explode("parts").alias("p")).select("conv_id", "p.type", "p.call_id")
    calls = p.filter("type = 'tool-call' and call_id is not null").select("conv_id", "call_id")
    return calls.join(p.filter("type = 'tool-result'").select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")


def drop_empty(messages: DataFrame, protected: int, mark: str = SUMMARY_MARK) -> DataFrame:
    """Plain-text messages without the blank answers inside the region, and their `dropped_chars` as rows of their own kind."""
    b = bounds(messages, protected).select("conv_id", "region_start", "region_end")
    inside = (F.col("pos") >= F.col("region_start")) & (F.col("pos") < F.col("region_end"))
    summary = F.coalesce(F.col("text").startswith(mark), F.lit(False))
    gone = inside & (F.col("role") == "assistant") & (F.col("kind") != "parts") & blank(F.col("text")) & ~summary
    return messages.join(b, "conv_id").withColumns({"dropped": gone, "chars": chars(F.col("kind"), F.col("text"), F.col("parts"))})


def merged_islands(messages: DataFrame, protected: int, mark: str = SUMMARY_MARK) -> DataFrame:
    """conv_id, first_pos, messages, text: runs of neighbouring plain answers inside the region as one text each.

    A run starts anew where the message before is of another role, outside of the
    conversation, or a summary; the first of a run may stand before the region.
    """
    b = bounds(messages, protected).select("conv_id", "region_start", "region_end")
    w = W.partitionBy("conv_id").orderBy("pos")
    summary = F.coalesce(F.col("text").startswith(mark), F.lit(False))
    inside = (F.col("pos") >= F.col("region_start")) & (F.col("pos") < F.col("region_end"))
    joins = inside & (F.col("role") == "assistant") & (F.lag("role").over(w) == "assistant") & ~F.lag(summary).over(w)
    rows = messages.join(b, "conv_id").withColumn("island", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w))
    texts = F.sort_array(F.collect_list(F.struct("pos", "text")))
    joined = F.array_join(F.transform(F.filter(texts, lambda x: F.coalesce(x["text"] != "", F.lit(False))), lambda x: x["text"]), "\n\n")
    return rows.filter("role = 'assistant'").groupBy("conv_id", "island").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("messages"), joined.alias("text")).drop("island")


def repeated_calls(calls: DataFrame, key: str, order: list[str], same: list[str]) -> DataFrame:
    """`calls` with `repeated`: the row before it of its key has equal `same` columns.

    Right for logs in which every call stands alone, with nothing beside it.
    """
    w = W.partitionBy(key).orderBy(*order)
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.lag(c).over(w))
    return calls.withColumn("repeated", (F.row_number().over(w) > 1) & equal)



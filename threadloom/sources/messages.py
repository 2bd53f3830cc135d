"""Conversations as rows of messages, ordered by an explicit position."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,call_id:string,tool:string,input:string,out_type:string,out:string,raw:string>"
SCHEMA = f"conv_id long, pos int, msg_id string, role string, kind string, text string, parts array<{PART}>"


def from_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of plain text, one per row of `turns`."""
    pos = turns[turn].cast("int")
    return turns.select(turns[conv].cast("long").alias("conv_id"), pos.alias("pos"), F.concat_ws("-", turns[conv], turns[turn]).alias("msg_id"), turns[role].alias("role"), F.when(turns[text].isNull(), "none").otherwise("string").alias("kind"), turns[text].alias("text"), F.lit(None).cast(f"array<{PART}>").alias("parts"))


def _compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def part(p: dict) -> dict:
    """One part of a message given as JSON; what isn't text, a call or a result is kept raw."""
    out = dict.fromkeys(("type", "text", "call_id", "tool", "input", "out_type", "out", "raw"))
    out["type"] = p.get("type")
    if p.get("type") == "text":
        out["text"] = p.get("text")
    elif p.get("type") == "tool-call":
        out |= {"call_id": p.get("toolCallId"), "tool": p.get("toolName"), "input": None if p.get("input") is None else _compact(p["input"])}
    elif p.get("type") == "tool-result":
        output = p.get("output") or {}
        value = output.get("value")
        out |= {"call_id": p.get("toolCallId"), "tool": p.get("toolName"), "out_type": output.get("type"), "out": value if isinstance(value, str) and output.get("type") in ("text", "error-text") else _compact(value)}
    else:
        out["raw"] = _compact(p)
    return out


def from_json(spark: SparkSession, conversations: dict[int, list[dict]]) -> DataFrame:
    """Messages given as Python objects with id, role and content; for small inputs such as fixtures."""
    rows = []
    for conv, messages in conversations.items():
        for pos, m in enumerate(messages):
            content = m.get("content")
            kind = "string" if isinstance(content, str) else "parts" if isinstance(content, list) else "none"
            rows.append((conv, pos, m.get("id") or f"{conv}-{pos}", m["role"], kind, content if kind == "string" else None, [part(p) for p in content] if kind == "parts" else None))
    return spark.createDataFrame(rows, SCHEMA)

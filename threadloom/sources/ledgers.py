"""Ledgers of JSON lines: a file and older generations of it, each with its number as suffix."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENERATIONS = 3
RUN = "kind string, task string, at long, chars_before long, chars_after long, saved long, structural long, error long, truncate long, summarize long, summarize_calls long, summarizer string"


def files(path: str) -> list[str]:
    """Oldest first."""
    return [*(f"{path}.{k}" for k in range(GENERATIONS, 0, -1)), path]


def append(path: str, record: dict, limit: int = 5 << 20) -> None:
    """Add a line; a file beyond the limit becomes generation 1 before, and the oldest goes."""
    if os.path.exists(path) and os.path.getsize(path) > limit:
        rotate(path)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, ensure_ascii=False) + "\n")


def rotate(path: str) -> None:
    chain = files(path)
    if os.path.exists(chain[0]):
        os.remove(chain[0])
    for newer, older in zip(chain[1:], chain[:-1]):
        if os.path.exists(newer):
            os.replace(newer, older)


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """generation, line, value of every non-blank line; paths are given oldest first."""
    parts = []
    for g, p in enumerate(paths):
        rows = spark.read.text(p, wholetext=True).select(F.posexplode(F.split("value", "\n", -1)).alias("line", "value"))
        parts.append(rows.select(F.lit(g).alias("generation"), "line", "value"))
    out = parts[0] if parts else spark.createDataFrame([], "generation int, line int, value string")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.trim("value") != "")


def run_records(rows: DataFrame) -> DataFrame:
    """Lines as run records with `valid`; a line is valid if it is JSON of kind run with a task and a size.

    Nothing is dropped silently: filter by `valid`, and count the others.
    """
    parsed = rows.withColumn("r", F.from_json("value", RUN))
    ok = (F.col("r.kind") == "run") & F.col("r.task").isNotNull() & F.col("r.chars_before").isNotNull()
    return parsed.select("generation", "line", F.coalesce(ok, F.lit(False)).alias("valid"), "r.*")


def write(records: DataFrame, folder: str) -> None:
    """Append records to a folder of JSON lines."""
    records.write.mode("append").json(folder)

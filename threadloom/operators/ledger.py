"""Aggregates over the records of runs and tasks.

A run record has task, at (epoch ms), chars_before, chars_after, saved and the
savings by pass; a stats record is a task's running totals.  Order within a
ledger is (generation, line), see sources.ledgers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import half_up, saved_cost, tokens

PASSES = ("structural", "error", "truncate", "summarize")


def run_records(reports: DataFrame, at: Column) -> DataFrame:
    """A record per touched report of compact()."""
    return reports.filter("touched").select(
        F.lit("run").alias("kind"), F.col("conv_id").cast("string").alias("task"), at.cast("long").alias("at"), "chars_before", "chars_after", (F.col("chars_before") - F.col("chars_after")).alias("saved"),
        *(F.col(f"{p}_removed").alias(p) for p in PASSES), "summarize_calls", "summarizer",
    )


def measure(records: DataFrame) -> DataFrame:
    """One row of totals over all runs; none for an empty ledger. The median is exact, halves are rounded upwards."""
    n = F.count(F.lit(1))
    saved = F.sum("saved")
    return records.agg(
        n.alias("runs"), F.count_distinct("task").alias("tasks"), (F.max("at") - F.min("at")).alias("span_ms"), F.sum("chars_before").alias("chars_before"), F.sum("chars_after").alias("chars_after"), saved.alias("saved"),
        tokens(saved).alias("saved_tokens"), half_up(saved / n).alias("mean_saved"), half_up(F.median("saved")).alias("median_saved"), F.max("saved").alias("max_saved"), F.sum("summarize_calls").alias("summarize_calls"),
    ).filter("runs > 0")


def by_task(records: DataFrame) -> DataFrame:
    """task, runs, saved, and first_at, which decides between equal savings."""
    return records.groupBy("task").agg(F.count(F.lit(1)).alias("runs"), F.sum("saved").alias("saved"), F.min("at").alias("first_at"))


def top_tasks(records: DataFrame, n: int = 5) -> DataFrame:
    return by_task(records).orderBy(F.desc("saved"), "first_at", "task").limit(n)


def task_stats(records: DataFrame) -> DataFrame:
    """Totals of each task, by pass."""
    return records.groupBy("task").agg(F.count(F.lit(1)).alias("passes"), *(F.sum(p).alias(p) for p in PASSES), F.sum("chars_before").alias("chars_before"), F.sum("chars_after").alias("chars_after"), F.sum("summarize_calls").alias("summarize_calls"), F.max_by("summarizer", F.when(F.col("summarizer") != "none", F.col("at"))).alias("last_summarizer"), F.max("at").alias("last_run_at"))


def running_stats(records: DataFrame, *position: str) -> DataFrame:
    """Each record with its task's totals so far; `position` names the columns that order records of equal time."""
    w = W.partitionBy("task").orderBy("at", *position).rowsBetween(W.unboundedPreceding, 0)
    return records.withColumns({"passes_so_far": F.count(F.lit(1)).over(w), "saved_so_far": F.sum("saved").over(w), "before_so_far": F.sum("chars_before").over(w)})


def latest(lines: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last line of each key; a struct's maximum, so nothing is sorted or gathered by key."""
    others = [c for c in lines.columns if c != key and c not in order]
    last = F.max_by(F.struct(*others), F.struct(*order)).alias("last") if others else F.lit(None).alias("last")
    return lines.groupBy(key).agg(last, *(F.max_by(c, F.struct(*order)).alias(c) for c in order)).select(key, *order, *(f"last.{c}" for c in others))


def repaired(stats: DataFrame) -> DataFrame:
    """Counters that old records lack are 0."""
    return stats.fillna(0, [c for c, t in stats.dtypes if t in ("bigint", "int", "double")])


def reset(lines: DataFrame, tasks: DataFrame) -> DataFrame:
    """The ledger without all lines of some tasks."""
    return lines.join(tasks.select("task").distinct(), "task", "left_anti")


def headline(stats: DataFrame) -> DataFrame:
    """What a task has saved: measured sizes where there are any, never below 0, else the sum of the passes."""
    summed = sum((F.col(p) for p in PASSES[1:]), F.col(PASSES[0]))
    measured = F.col("chars_before") > 0
    return stats.withColumns({"measured": measured, "saved_total": F.when(measured, F.greatest(F.col("chars_before") - F.col("chars_after"), F.lit(0))).otherwise(summed)})


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """`usage` with the price per million input tokens of its provider and model, or of the first such model of any provider.

    `prices` has place, provider, model and per_token; of several rows the first
    place counts, and a price that isn't above 0 is unknown.
    """
    first = lambda keys: prices.groupBy(*keys).agg(F.min_by("per_token", "place").alias("per_token"), F.min_by("provider", "place").alias("by"))
    exact = first(["provider", "model"]).select("provider", "model", F.col("per_token").alias("exact"), F.lit(True).alias("found"))
    loose = prices.groupBy("model").agg(F.min_by("per_token", "place").alias("loose"))
    joined = usage.join(exact, ["provider", "model"], "left").join(loose, "model", "left")
    per_token = F.when(F.coalesce("found", F.lit(False)), F.col("exact")).otherwise(F.col("loose"))
    return joined.withColumn("per_million", F.when(per_token > 0, per_token * 1_000_000)).drop("exact", "loose", "found")


def with_cost(usage: DataFrame, prices: DataFrame, saved_tokens: str = "saved_tokens") -> DataFrame:
    return priced(usage, prices).withColumn("saved_usd", saved_cost(F.col(saved_tokens), F.col("per_million")))

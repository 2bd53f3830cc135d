"""The whole plan: clean, summarise errors, truncate, summarise, report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators.passes import Marks, error_pass, truncate_pass
from ..operators.region import chars
from ..operators.structural import structural
from ..operators.summarize import summarized

LEAST = 4
LEVELS = ("structural", "truncate", "summarize")


def compact(messages: DataFrame, config: Config = Config(), generate: Callable[[str], str] | None = None, cache: DataFrame | None = None, disabled: DataFrame | None = None, marks: Marks = Marks()) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Messages for the next model call, a report per conversation, and summaries to keep (None below that level).

    Errors are summarised before truncation, so that they are seen whole; the
    thresholds of truncation and summaries look at the size before any pass.
    `disabled` has conv_id of conversations for which summaries are switched off.
    What the clean-up decides is computed when this is called, once for all outputs; the passes after it are projections.
    `generate` runs before this returns, once for each conversation that needs a summary.
    """
    depth = LEVELS.index(config.level)
    df = structural(messages, config.protectedTurns, LEAST, config.enabled, marks.summary)
    large = F.col("chars_before") > config.maxContextChars
    zero = F.lit(0).cast("long")
    if depth >= 1 and config.enabled and config.errors.enabled:
        df = error_pass(df, config.errors.minChars, config.errors.contextLines, marks)
    else:
        df = df.withColumn("error_removed", zero)
    if depth >= 1 and config.enabled:
        df = truncate_pass(df, config.truncate.maxLines, config.truncate.maxKB, config.truncate.maxInputChars, marks, large)
    else:
        df = df.withColumn("truncate_removed", zero)
    totals = df.groupBy("conv_id").agg(
        F.first("n_before").alias("n_before"), F.first("chars_before").alias("chars_before"), F.first("structural_removed").alias("structural_removed"),
        F.sum("error_removed").alias("error_removed"), F.sum("truncate_removed").alias("truncate_removed"), F.sum(chars(F.col("kind"), F.col("text"), F.col("parts"))).alias("chars_after"),
    )
    keep = None
    out = df
    if depth == 2 and config.enabled and generate:
        able = df.filter(large)
        if disabled is not None:
            able = able.join(disabled.select("conv_id"), "conv_id", "left_anti")
        swapped, result, keep = summarized(able, config.summarize, generate, cache, marks)
        out = swapped.unionByName(df.join(able.select("conv_id").distinct(), "conv_id", "left_anti"))
        totals = totals.join(result.select("conv_id", "summarize_removed", "summarized_ranges", "summarize_calls", "summarize_failed", "summarizer"), "conv_id", "left")
    else:
        totals = totals.withColumns({"summarize_removed": zero, "summarized_ranges": F.lit(0), "summarize_calls": F.lit(0), "summarize_failed": F.lit(False), "summarizer": F.lit("none")})
    totals = totals.fillna({"summarize_removed": 0, "summarized_ranges": 0, "summarize_calls": 0, "summarize_failed": False, "summarizer": "none"})
    saved = F.col("structural_removed") + F.col("error_removed") + F.col("truncate_removed") + F.col("summarize_removed")
    report = totals.select(
        "conv_id", "n_before", "chars_before", (F.col("chars_after") - F.col("summarize_removed")).alias("chars_after"), "structural_removed", "error_removed", "truncate_removed", "summarize_removed", "summarized_ranges", "summarize_calls", "summarize_failed", "summarizer",
        ((saved > 0) | (F.col("summarized_ranges") > 0) | F.col("summarize_failed")).alias("touched"),
    )
    return out.select("conv_id", "pos", "msg_id", "role", "kind", "text", "parts"), report, keep

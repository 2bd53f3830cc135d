"""Which messages of a conversation may be rewritten, and how large they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import JSON_OUTPUTS, TEXT_OUTPUTS, tokens, u16len

#: Messages at the end that stay when there are fewer user turns than are protected.
TAIL = 5
#: Positions per partial list of user turns.
SLAB = 1024


def part_text(p: Column) -> Column:
    """A part as text: its text, its call's input, or its result's output; empty for other kinds."""
    known = p["out_type"].isin(*TEXT_OUTPUTS, *JSON_OUTPUTS, "error-json")
    return F.coalesce(F.when(p["type"] == "text", p["text"]).when(p["type"] == "tool-call", p["input"]).when((p["type"] == "tool-result") & known, p["out"]), F.lit(""))


def chars(kind: Column, text: Column, parts: Column) -> Column:
    whole = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + u16len(part_text(p)))
    return F.when(kind == "string", u16len(text)).when(kind == "parts", whole).otherwise(F.lit(0).cast("long"))


def edges(n: Column, first_user: Column, nth_user: Column) -> tuple[Column, Column]:
    """Start and end of the region, from the number of messages, the first user message and the p-th from the end.

    It begins after the first user message, which states the task, and ends at
    the p-th user message from the end; with fewer than p, TAIL messages stay.
    """
    start = F.greatest(first_user + 1, F.lit(1))
    end = F.greatest(F.coalesce(nth_user, n - TAIL), first_user + 1)
    none = first_user.isNull()
    return F.when(none, 0).otherwise(start).cast("int"), F.when(none, 0).otherwise(end).cast("int")


def bounds(messages: DataFrame, protected: int) -> DataFrame:
    """conv_id, n_messages, user_turns, region_start, region_end: rows from start to before end may change.

    The last p user positions are found by two aggregations that never hold more
    than SLAB of them, so a conversation of any length is summed up where it is read.
    """
    user = F.when(F.col("role") == "user", F.col("pos"))
    last = lambda c: F.slice(F.sort_array(c, asc=False), 1, protected)
    slabs = messages.groupBy("conv_id", F.floor(F.col("pos") / SLAB).alias("slab")).agg(F.count(F.lit(1)).alias("n"), F.count(user).alias("users"), F.min(user).alias("first"), last(F.collect_list(user)).alias("last"))
    whole = slabs.groupBy("conv_id").agg(F.sum("n").cast("int").alias("n_messages"), F.sum("users").cast("int").alias("user_turns"), F.min("first").alias("first"), last(F.flatten(F.collect_list("last"))).alias("last"))
    start, end = edges(F.col("n_messages"), F.col("first"), F.get("last", F.lit(protected - 1)))
    return whole.select("conv_id", "n_messages", "user_turns", start.alias("region_start"), end.alias("region_end"))


def region_rows(messages: DataFrame, protected: int) -> DataFrame:
    """The messages inside the regions."""
    b = bounds(messages, protected).filter("region_start < region_end").select(F.col("conv_id").alias("region_conv"), "region_start", "region_end")
    return messages.join(b, (messages.conv_id == b.region_conv) & (messages.pos >= b.region_start) & (messages.pos < b.region_end)).select(messages["*"])


def sizes(messages: DataFrame) -> DataFrame:
    """conv_id, messages, chars, tokens."""
    summed = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.sum(chars(F.col("kind"), F.col("text"), F.col("parts"))).alias("chars"))
    return summed.withColumn("tokens", tokens(F.col("chars")))

"""Corpus pipeline: language, quality, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of `docs`, whatever others there are
beside doc_id, text, lang and source and whatever their names.  Null texts and
texts without letters are rejected by the first stage, so later stages see none
unless they are called by themselves; there a null text counts as empty.  Where
no row has a language, or none a label, the first or second stage rejects nothing
but texts without letters.  Rows that share a doc_id, or have none, share the
verdict of the quality stage: they go only when all of them are rejected; exact
duplicates among them are told apart by their text, near duplicates by their
words, so one row of each class stays whatever its doc_id is.  An empty table
stays empty.  A text of any length goes through whole, in one worker's memory;
see the operators for what each takes per byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import exact, langid, neardup, packing, quality
from threadloom.llm.common import column, prepare, remove, scratch, settle, table
from threadloom.llm.queries import tokenizer_file


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    kept = ids.select(F.col("doc_id").alias("__kept"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi")


def _verdicts(rows: DataFrame) -> DataFrame:
    return settle(rows.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("stay")))


def _lowered(text: Column) -> Column:
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a recognised language; each row has its own verdict."""
    found = langid.predict(docs, langid.fitted(docs), keep=docs.columns, prefix="__langid_")
    return found.filter(~F.col("__langid_rejected")).select(*map(column, docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality posterior accepts; without labels, all."""
    rows = quality.assess(docs, table(spark, sf_dir, "labels"))
    return _without(docs, _verdicts(rows).filter("not kept"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of equal texts the row with the largest doc_id; a null id is smaller than any, and one of repeated rows stays."""
    rows = settle(exact.exact_groups(docs))
    verdicts = _verdicts(rows)
    out = _without(docs, verdicts.filter("not kept or n > 1"))
    repeated = verdicts.filter("n > 1")
    if repeated.isEmpty():
        return out
    stay = _only(rows, repeated).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    again = _only(docs, repeated).withColumn("__own", _lowered(F.col("text")))
    again = again.join(stay, again["doc_id"].eqNullSafe(stay["__id"]) & (again["__own"] == stay["__sha"]), "left_semi")
    return out.unionByName(again.dropDuplicates(["doc_id", "__own"]).drop("__own"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, that with the smallest doc_id; a null id is larger than any, and one of repeated rows stays."""
    rows = settle(neardup.near_rows(docs))
    verdicts = _verdicts(rows)
    out = _without(docs, verdicts.filter("not kept or n > 1"))
    repeated = verdicts.filter("n > 1 and kept")
    if repeated.isEmpty():
        return out
    stay = _only(rows.filter("kept"), repeated).select(F.col("doc_id").alias("__id"), F.col("content").alias("__content"))
    again = neardup.content(_only(docs, repeated), "text", "__own")
    again = again.join(stay, again["doc_id"].eqNullSafe(stay["__id"]) & (again["__own"] == stay["__content"]), "left_semi")
    return out.unionByName(again.dropDuplicates(["doc_id", "__own"]).drop("__own"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens; a null or empty text is its end id alone."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=0, max_len=2048)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Language models, the classifier and the tokenizer are beyond SQL; tests recompute the stages' decisions by other means.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        folder = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(folder), folder
    packed = settle(STAGES[-1][1](spark, docs, sf_dir))
    if before:
        remove(spark, before)
    return packed

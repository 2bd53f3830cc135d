import collections

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from threadloom.llm import exact, langid, neardup, quality

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    """Every stage keeps exactly what its operator says of its own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("kept", F.lit("x"))
    columns = docs.columns
    verdicts = {
        "language_id": lambda d: langid.predict(d, langid.fitted(d)).select("doc_id", (~F.col("rejected")).alias("kept")),
        "quality_classifier": lambda d: quality.assess(d, spark.read.parquet(f"{FOLDER}/labels.parquet")),
        "exact_dedup": exact.exact_groups,
        "near_dedup": neardup.near_groups,
    }
    assert [n for n, _ in pipeline.STAGES] == [*verdicts, "best_fit_packing"]
    for name, stage in pipeline.STAGES[:-1]:
        kept = collections.defaultdict(bool)
        for r in verdicts[name](docs).collect():
            kept[r.doc_id] |= r.kept
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert {r.doc_id for r in out.select("doc_id").collect()} == {i for i, k in kept.items() if k}, name
        docs = out
    assert docs.count() == docs.select("doc_id").distinct().count()
    packed = pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_near_dedup_keeps_a_text_of_each_class(spark, frame, prose):
    near = prose(3).rsplit(" ", 1)[0] + " changed"
    rows = [(None, prose(1)), (None, prose(2)), (None, prose(2).upper()), (3, prose(3)), (5, near), (5, prose(4)), (5, prose(5)), (6, prose(5)), (7, prose(6)), (7, prose(6))]
    docs = frame(rows)
    out = pipeline.near_dedup(spark, docs, FOLDER)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text.lower()) for r in out.collect())
    assert got == sorted([(0, prose(1)), (0, prose(2)), (3, prose(3)), (5, prose(4)), (5, prose(5)), (7, prose(6))])


def test_dedup_and_packing_against_brute_force(spark):
    """Stages 3 to 5 on a whole table: equal texts by a dictionary, near ones over all pairs, tokens by the library."""
    from tokenizers import Tokenizer

    from .test_pairs import LOWER, classes

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    last = {}
    for r in docs.collect():
        last[(r.text or "").translate(LOWER)] = max(r.doc_id, last.get((r.text or "").translate(LOWER), -1))
    out = pipeline.exact_dedup(spark, docs, FOLDER)
    assert sorted(r.doc_id for r in out.collect()) == sorted(last.values())
    out = spark.createDataFrame(out.collect(), docs.schema)
    rows = [(r.doc_id, r.text) for r in out.collect()]
    near = pipeline.near_dedup(spark, out, FOLDER)
    assert sorted(r.doc_id for r in near.collect()) == sorted(min(rows[k][0] for k in g) for g in classes(rows))
    t = Tokenizer.from_file(pipeline.tokenizer_file("word_bpe_49k.json"))
    near = spark.createDataFrame(near.collect(), docs.schema)
    packed = pipeline.best_fit_packing(spark, near, FOLDER).collect()
    sizes = collections.Counter()
    for r in packed:
        sizes[r.doc_id] += r.length
    assert sizes == {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in near.collect()}
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(i[0] + i[1] == j[0] for i, j in zip(b, b[1:])) and sum(b[-1]) <= 2048
    assert len(bins) <= 1.01 * -(-sum(sizes.values()) // 2048) + 1


def test_stages_of_odd_tables(spark, frame, prose):
    """Nulls, repeats, a very long text, columns with clashing and dotted names, and no rows at all."""
    rows = [(1, prose(1)), (1, prose(1)), (2, None), (None, prose(2)), (None, None), (3, ""), (4, prose(4, 40_000)), (5, prose(4, 40_000))]
    docs = frame(rows).withColumns({"a.b": F.lit(1), "content": F.lit("c"), "n": F.lit(2), "lang_pred": F.lit("x")})
    want = {"language_id": 5, "quality_classifier": 8, "exact_dedup": 4, "near_dedup": 4}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.count() == want[name], name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    assert pipeline.best_fit_packing(spark, docs, FOLDER).count() > 8 and pipeline.best_fit_packing(spark, docs.limit(0), FOLDER).count() == 0


def test_run(spark):
    got = pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0

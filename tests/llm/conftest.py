import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    """Documents with a null text, an empty one, ties, repeats, a null id and a column whose name clashes."""

    def make(rows):
        out = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        from pyspark.sql import functions as F

        return out.withColumns({"score": F.lit("x"), "kept": F.lit(1), "uid": F.lit("u")})

    return make


WORDS = "the of and to in that was for with from this have not but they which you were her all one there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through years where much your way well down should because each just those people too mr how little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()


@pytest.fixture
def prose():
    import random

    def make(seed, n=120):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))

    return make

"""Dollar amounts are rounded as by printf."""

import math

import duckdb
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.plans.queries import ORACLE, QUERIES


def test_halves_and_their_neighbours(spark):
    halves = [m / 1000 for m in range(5, 30_000, 10)] + [m / 100_000 for m in range(5, 1000, 10)] + [m / 8 for m in range(1, 400)]
    items = [y for x in halves for y in (x, math.nextafter(x, 0), math.nextafter(x, 9e9))] + [0.01, 0.00995, 0.999, 0.995, 5e-324, 2.0**45 + 0.015625, 2.0**53, math.nextafter(2.0**63, 0)]
    rows = spark.createDataFrame(list(enumerate(items)), "i int, x double")
    got = [r[0] for r in rows.orderBy("i").select(text.usd(F.col("x"))).collect()]
    assert got == [f"${x:.4f}" if x < 0.01 else f"${x:.2f}" for x in items]


def test_usd_format_of_other_keys(spark, tmp_path):
    keys = [None, -5, 3, 10, 11, 2**62, *range(503, 60_000, 1000), *range(12_503, 200_000, 12_500)]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["usd_format"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, c.execute(ORACLE["usd_format"]).fetchall()))

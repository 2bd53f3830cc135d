"""Rules that depend on what came before within a key."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FAILURES = 3
LOG_CHARS, LOG_MS, PERSIST_MS = 4000, 5 * 60 * 1000, 60 * 1000


def failure_gate(runs: DataFrame, key: str, order: list[str], limit: int = FAILURES) -> DataFrame:
    """`runs` (with booleans failed and succeeded) with `open`: whether summaries were still on for the run.

    `limit` failures without a success between them switch summaries off for the
    rest of the key, as no later run can succeed; neutral runs count for nothing.
    Two running sums find the place, no state is kept.
    """
    w = W.partitionBy(key).orderBy(*order)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    rows = runs.withColumn("__round", F.sum(F.when(F.col("succeeded"), 1).otherwise(0)).over(so_far))
    in_round = W.partitionBy(key, "__round").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__failed", F.sum(F.when(F.col("failed"), 1).otherwise(0)).over(in_round))
    before = F.max("__failed").over(w.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("open", F.coalesce(before, F.lit(0)) < limit).drop("__round", "__failed")


def throttled(rows: DataFrame, key: str, at: str, gap: int, strict: bool, due: str | None = None, tie: list[str] | None = None) -> DataFrame:
    """`rows` with `emitted`: true where `due` holds and the last emitted row of the key is at least `gap` away (more than, if strict).

    Rows are sorted by key and time within partitions and read as a stream, so a
    key of any size needs no memory, but one task reads it.  The first row that is
    due is emitted; of rows with equal times the first by the columns `tie`, which
    should tell all rows of a key apart.  Null times come first and count as 0.
    """
    chosen = rows.withColumn("__due", F.coalesce(F.col(due), F.lit(False)) if due else F.lit(True))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        last_key, last = None, None
        for b in batches:
            out = []
            for k, t, d in zip(b.column(key).to_pylist(), b.column(at).to_pylist(), b.column("__due").to_pylist()):
                t = t or 0
                if k != last_key:
                    last_key, last = k, None
                emit = d and (last is None or (t - last > gap if strict else t - last >= gap))
                if emit:
                    last = t
                out.append(emit)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.bool_())], [*b.schema.names[:-1], "emitted"])

    return chosen.repartition(key).sortWithinPartitions(key, at, *(tie or [])).mapInArrow(run, f"{fields}, emitted boolean")

"""Which files of an archive have to go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY_MS = 86_400_000
CAP, WATERMARK, DAYS = 100 << 20, 80 << 20, 30
SLAB_MS = 3_600_000


def retention(files: DataFrame, now_ms: int, cap: int = CAP, watermark: int = WATERMARK, days: int | None = DAYS) -> DataFrame:
    """`files` (path, mtime in ms, size) with `reason`: age, cap or null for those that stay.

    Files older than `days` go first.  If the others exceed the cap, the oldest
    go until no more than the watermark is left.  Bytes before a file are those
    of earlier hours, summed per hour first, and of its own hour, so the running
    sum over all files is taken over hours alone.
    """
    old = F.lit(now_ms) - F.col("mtime") > days * DAY_MS if days else F.lit(False)
    rows = files.withColumns({"old": old, "slab": F.floor(F.col("mtime") / SLAB_MS)})
    young = rows.filter("not old")
    hours = young.groupBy("slab").agg(F.sum("size").alias("bytes"))
    earlier = hours.select("slab", F.coalesce(F.sum("bytes").over(W.orderBy("slab").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"), F.sum("bytes").over(W.orderBy("slab").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    w = W.partitionBy("slab").orderBy("mtime", "path").rowsBetween(W.unboundedPreceding, -1)
    kept = young.join(earlier, "slab").withColumn("left_before", F.col("total") - F.col("earlier") - F.coalesce(F.sum("size").over(w), F.lit(0)))
    kept = kept.withColumn("reason", F.when((F.col("total") > cap) & (F.col("left_before") > watermark), "cap"))
    gone = rows.filter("old").withColumn("reason", F.lit("age"))
    return kept.select(*files.columns, "reason").unionByName(gone.select(*files.columns, "reason"))

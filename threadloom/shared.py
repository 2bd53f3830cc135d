"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where it is unset, a temporary folder, which is possible on a local master only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="threadloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def once(df: DataFrame) -> DataFrame:
    """`df` as computed now, however often it is used."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{folder(spark).rstrip('/')}/threadloom-{uuid.uuid4().hex}"

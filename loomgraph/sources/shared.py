"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir; sessions without it (tests, local use) get a folder of their own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomgraph-"))


def cut(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut, in reliable storage: loops stay flat and a
    lost executor costs only its tasks."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)

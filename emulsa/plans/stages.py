"""Cuts between stages whose results are read more than once."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share (one of our own only on one machine)."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="emulsa-"))
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

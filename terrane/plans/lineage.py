"""Checkpoints in the shared folder, for loops whose plans would grow."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources import folders


def cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folders.shared(spark, "cut"))
    return df.checkpoint()

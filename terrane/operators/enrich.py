"""Tags from tables: speeds by way id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import add_or_replace_tag
from ..functions.text import speed_text


def read_speeds(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header: way id, speed. Rows keep the order of the file as line."""
    return spark.read.csv(path, header=True, schema="way_id bigint, speed double").withColumn("line", F.monotonically_increasing_id())


def set_speeds(ways: DataFrame, speeds: DataFrame, key: str = "maxspeed:motorcar") -> DataFrame:
    """Ways with the tag set from the last row of their id. Ids that no way has are passed over."""
    last = speeds.groupBy("way_id").agg(F.max_by("speed", "line").alias("_speed"))
    joined = ways.join(last, ways["id"] == last["way_id"], "left")
    return joined.withColumn("tags", F.when(F.col("_speed").isNotNull(), add_or_replace_tag(F.col("tags"), key, speed_text(F.col("_speed")))).otherwise(F.col("tags"))).select(*ways.columns)

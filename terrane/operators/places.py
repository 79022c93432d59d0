"""Numbering of rows in an order, without one task that sees all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

LOCAL = 33  # bits that a monotonically increasing id has for the place within a partition


def numbered(df: DataFrame, order: list[str], out: str = "place") -> DataFrame:
    """df with a number from 1 by the order, which must name each row once. Ranges are sorted where they lie; only their sizes meet."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranges = cut(ranges.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", LOCAL)
    sizes = ranges.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return ranges.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << LOCAL) - 1)) + 1).drop("_part", "_at", "_start")

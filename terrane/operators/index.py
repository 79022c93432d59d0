"""The tile index: the tile of a way's first node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tiles import degrees, x_tile, y_tile


def first_nodes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id and its first node's coordinates. Ways without nodes, or whose first node is missing, are left out."""
    first = ways.select(F.col("id").alias("way_id"), F.get("nodes", F.lit(0)).alias("node_id")).where("node_id is not null")
    return first.join(nodes.select(F.col("id").alias("node_id"), "fixed_lat", "fixed_lon"), "node_id")


def tile_index(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    return first_nodes(ways, nodes).select(x_tile(degrees(F.col("fixed_lon"))).alias("xtile"), y_tile(degrees(F.col("fixed_lat"))).alias("ytile"), "way_id")

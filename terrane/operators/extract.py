"""Extracts: whole ways by the tile of their first node, their nodes, and the relations that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tiles import tile_range
from ..model import OsmDataset, members, way_refs
from ..plans.lineage import cut
from .analyze import relation_index
from .index import tile_index


def in_tiles(index: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Literals on both axes, so a table that is laid out by xtile is pruned to the columns and row groups in question."""
    if x0 > x1 or y0 > y1:
        raise ValueError(f"not a tile range: {x0},{y0} to {x1},{y1}")
    return index.where(F.col("xtile").between(x0, x1) & F.col("ytile").between(y0, y1))


def parents(relations: DataFrame, start: DataFrame) -> DataFrame:
    """start (relation_id) and all relations that hold one of them, directly or not. Each round follows only what the last one found."""
    links = cut(relation_index(relations, "RELATION").select("member_id", F.col("relation_id").alias("parent")))  # each round reads them
    known = cut(start.select("relation_id").distinct())
    front = known
    while not front.isEmpty():
        found = front.join(links, F.col("relation_id") == F.col("member_id")).select(F.col("parent").alias("relation_id")).distinct()
        front = cut(found.join(known, "relation_id", "left_anti"))
        known = known.unionByName(front)
    return known


def extract_ways(ds: OsmDataset, box: tuple[float, float, float, float], index: DataFrame | None = None) -> DataFrame:
    chosen = in_tiles(tile_index(ds.ways, ds.nodes) if index is None else index, *tile_range(*box)).select(F.col("way_id").alias("id")).distinct()
    return ds.ways.join(chosen, "id", "left_semi")


def nodes_of(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node once; nodes that are missing are left out."""
    return nodes.join(way_refs(ways).select(F.col("node_id").alias("id")).distinct(), "id", "left_semi")


def relations_of(ds: OsmDataset, ways: DataFrame, nodes: DataFrame, compat: bool = False) -> DataFrame:
    """Relations with one of the ways or nodes as member, and their parents. compat: nodes are looked up by the ways' ids, and parents are not followed."""
    asked = lambda df, kind: df.select(F.lit(kind).alias("type"), F.col("id").alias("member_id"))
    held = asked(ways, "WAY").unionByName(asked(ways if compat else nodes, "NODE"))
    direct = members(ds.relations).join(held, ["type", "member_id"], "left_semi").select("relation_id").distinct()
    found = direct if compat else parents(ds.relations, direct)
    return ds.relations.join(found.select(F.col("relation_id").alias("id")), "id", "left_semi")


def extract(ds: OsmDataset, box: tuple[float, float, float, float], *, index: DataFrame | None = None, compat: bool = False) -> OsmDataset:
    """box: min lat, min lon, max lat, max lon. Ways are complete, relations whole, nodes only those of the ways."""
    ways = cut(extract_ways(ds, box, index))  # read by all that follows
    nodes = nodes_of(ways, ds.nodes)
    return OsmDataset(nodes, ways, relations_of(ds, ways, nodes, compat), ds.meta)


def in_tile_order(ways: DataFrame, index: DataFrame) -> DataFrame:
    return ways.join(index.withColumnRenamed("way_id", "id"), "id").orderBy("xtile", "ytile", "id")

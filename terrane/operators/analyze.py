"""Aggregates over entities: references, intersections, cardinalities, tag weights, content equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import has_tag, no_tags, tag_text
from ..model import OsmDataset, members, way_refs


def not_buildings(ways: DataFrame) -> DataFrame:
    """Any value of building rules a way out, even no."""
    return ways.where(~has_tag(F.col("tags"), "building"))


def referenced_nodes(ways: DataFrame) -> DataFrame:
    return way_refs(not_buildings(ways)).select("node_id").distinct()


def intersection_nodes(ways: DataFrame) -> DataFrame:
    """Nodes that ways other than buildings name at least twice, a ring's first node too."""
    return way_refs(not_buildings(ways)).groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node_id")


def id_bitmaps(ids: DataFrame, column: str) -> DataFrame:
    """The set of ids as bitmaps of 64 ids, one for each bucket that has any, so that a sparse set takes no more rows than it has ids."""
    return ids.groupBy(_bucket(column).alias("bucket")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _place(column))).alias("bits"))


def _bucket(column: str) -> Column:
    return F.shiftright(F.col(column).cast("long"), 6)


def _place(column: str) -> Column:
    return F.col(column).cast("long").bitwiseAND(F.lit(63)).cast("int")


def cardinality(ids: DataFrame, column: str) -> DataFrame:
    """Exact number of distinct ids, from the bitmaps."""
    return id_bitmaps(ids, column).agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("n"))


class IdSet:
    """A set of ids, kept as bitmaps. mark() says of each row whether its id is inside; a subclass may decide otherwise."""

    def __init__(self, ids: DataFrame, column: str):
        self.bitmaps = id_bitmaps(ids.where(F.col(column).isNotNull()), column)

    def mark(self, df: DataFrame, column: str, out: str) -> DataFrame:
        told = F.coalesce(F.getbit("_bits", _place(column)) == 1, F.lit(False))
        sets = self.bitmaps.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
        return df.join(sets, _bucket(column) == F.col("_bucket"), "left").select(*[F.col(f"`{c}`") for c in df.columns if c != out], told.alias(out))


class EveryId(IdSet):
    """The set that holds every id."""

    def __init__(self):
        pass

    def mark(self, df: DataFrame, column: str, out: str) -> DataFrame:
        return df.withColumn(out, F.col(column).isNotNull())


def relation_index(relations: DataFrame, kind: str) -> DataFrame:
    """member_id, relation_id of one type of member, as a set."""
    return members(relations).where(F.col("type") == kind).select("member_id", "relation_id").distinct()


def string_weights(ds: OsmDataset) -> DataFrame:
    """For each key, value and key=value over all entities, its UTF-16 length times its occurrences."""
    tags = ds.nodes.select("tags").unionByName(ds.ways.select("tags")).unionByName(ds.relations.select("tags")).select(F.explode(F.coalesce("tags", no_tags())).alias("t"))
    strings = tags.select(F.explode(F.array("t.key", "t.value", tag_text(F.col("t")))).alias("string"))
    return strings.groupBy("string").agg(F.sum(F.length(F.encode("string", "UTF-16BE")) / 2).cast("long").alias("weight"))


def tag_weights(ds: OsmDataset, over: int = 100_000) -> DataFrame:
    return string_weights(ds).where(F.col("weight") > over).select("weight", "string")


def write_tag_weights(ds: OsmDataset, path: str, over: int = 100_000) -> None:
    tag_weights(ds, over).write.option("sep", "|").csv(path)


def _normal(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", F.coalesce("tags", no_tags()))


def differences(a: OsmDataset, b: OsmDataset) -> DataFrame:
    """Rows of either dataset that the other lacks: kind, side, id. None if their contents are equal."""
    out = None
    for kind in ("nodes", "ways", "relations"):
        x, y = _normal(getattr(a, kind)), _normal(getattr(b, kind))
        y = y.select(*x.columns)
        for side, d in (("left", x.exceptAll(y)), ("right", y.exceptAll(x))):
            rows = d.select(F.lit(kind).alias("kind"), F.lit(side).alias("side"), "id")
            out = rows if out is None else out.unionByName(rows)
    return out

"""Changes: keyed upserts and deletes, last one wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import MEMBERS, TAGS, OsmDataset

#: seq: of the diff; ord: place in it. An upsert carries the columns of its type.
CHANGES = f"seq bigint, ord bigint, op string, type string, id bigint, fixed_lat int, fixed_lon int, nodes array<bigint>, members {MEMBERS}, tags {TAGS}"


def last_changes(changes: DataFrame) -> DataFrame:
    """The last change of each entity. Changes without an id are not applied."""
    w = Window.partitionBy("type", "id").orderBy(F.desc("seq"), F.desc("ord"))
    return changes.where("id is not null and id >= 0").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(base: DataFrame, last: DataFrame) -> DataFrame:
    """base without the changed ids, and the upserts. last: one row for each id."""
    return base.join(last.select("id"), "id", "left_anti").unionByName(last.where("op = 'upsert'").select(*base.columns))


def apply_changes(ds: OsmDataset, changes: DataFrame, timestamp: int | None = None, sequence: int | None = None) -> OsmDataset:
    """The dataset after the changes. Derived indexes are views, so they follow."""
    last = last_changes(changes)
    nodes, ways, relations = (upsert(getattr(ds, n), last.where(F.col("type") == t)) for n, t in (("nodes", "NODE"), ("ways", "WAY"), ("relations", "RELATION")))
    meta = ds.meta
    if timestamp is not None or sequence is not None:
        meta = meta.select(*(c.alias(n) if c is not None else F.col(n) for n, c in (("replication_timestamp", None if timestamp is None else F.lit(timestamp).cast("long")), ("sequence_number", None if sequence is None else F.lit(sequence).cast("long")))))
    return OsmDataset(nodes, ways, relations, meta)


def applied_counts(changes: DataFrame) -> DataFrame:
    """How many changes are applied, by type and op: all of them, also those that a later one overtakes."""
    return changes.where("id is not null and id >= 0").groupBy("type", "op").agg(F.count(F.lit(1)).alias("n"))


def reindexed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ways whose tile is another after a change: xtile, ytile, way_id as they are now."""
    old = before.select("way_id", F.struct("xtile", "ytile").alias("_old"))
    return after.join(old, "way_id").where(F.struct("xtile", "ytile") != F.col("_old")).select("xtile", "ytile", "way_id")


def pending(diffs: DataFrame, after: int) -> DataFrame:
    """Diffs strictly newer than a timestamp, in order."""
    return diffs.where(F.col("timestamp") > after).orderBy("seq")

"""Sets that follow from references, kept by counting: what a change takes away and adds is summed, and only the ids that it names are met.

For each node: refs, references of ways other than buildings (each mention counts, so a ring's first node counts twice); all_refs, of all ways; and
present, whether the node itself is there. A node with no count left has no row. Referenced, intersection and dangling nodes are filters on these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import has_tag

COUNTS = "id bigint, refs bigint, all_refs bigint, present bigint"
NAMES = ("refs", "all_refs", "present")


def _of_ways(ways: DataFrame, sign: int) -> DataFrame:
    """What ways (id, nodes, tags) count for, times sign."""
    plain = F.when(has_tag(F.col("tags"), "building"), 0).otherwise(sign)
    said = ways.select(plain.cast("long").alias("refs"), F.explode("nodes").alias("id"))
    return said.select("id", "refs", F.lit(sign).cast("long").alias("all_refs"), F.lit(0).cast("long").alias("present"))


def _of_nodes(nodes: DataFrame, sign: int) -> DataFrame:
    zero = F.lit(0).cast("long")
    return nodes.select("id", zero.alias("refs"), zero.alias("all_refs"), F.lit(sign).cast("long").alias("present"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(*(F.sum(c).alias(c) for c in NAMES))


def counted() -> Column:
    """Whether any count is left."""
    return F.expr(" OR ".join(f"{c} <> 0" for c in NAMES))


def _any(counts: DataFrame) -> DataFrame:
    return counts.where(counted())


def counts(ways: DataFrame, nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """From scratch. parts: in so many partitions, each a range of ids, by the only shuffle."""
    rows = _of_ways(ways, 1).unionByName(_of_nodes(nodes, 1))
    return _any(_summed(rows if parts is None else rows.repartitionByRange(parts, "id")))


def count_deltas(old_ways: DataFrame, new_ways: DataFrame, old_nodes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """What changes make of counts: the ways and nodes that they replace or delete, and those that they bring."""
    rows = _of_ways(old_ways, -1).unionByName(_of_ways(new_ways, 1)).unionByName(_of_nodes(old_nodes, -1)).unionByName(_of_nodes(new_nodes, 1))
    return _any(_summed(rows))


def advance(old: DataFrame, deltas: DataFrame) -> DataFrame:
    """What the ids that deltas name count after changes, also those with no count left. old: the rows of these ids."""
    return _summed(old.unionByName(deltas))


def referenced() -> Column:
    return F.col("refs") > 0


def intersection() -> Column:
    return F.col("refs") > 1


def dangling() -> Column:
    """Named by a way, and not there."""
    return (F.col("all_refs") > 0) & (F.col("present") == 0)


def unused() -> Column:
    """There, and named by no way."""
    return (F.col("all_refs") == 0) & (F.col("present") > 0)

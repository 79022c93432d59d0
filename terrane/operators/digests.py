"""Comparison of datasets by trees of digests: only ranges of ids whose digests differ are looked at.

A leaf has the ids of one range of 2 ** LEAF; its digest is the count and the sum of two hashes of each row's content, so that it doesn't hang on
the order of rows. A node of the next level has 2 ** FAN of these. A tree is a small table that can be kept with a dataset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import no_tags
from ..model import OsmDataset
from ..plans.lineage import cut

LEAF, FAN, LEVELS = 8, 8, 7  # the last level spans all 64-bit ids
KINDS = ("nodes", "ways", "relations")


def _content(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c), no_tags()) if c == "tags" else F.col(c) for c in sorted(df.columns)]


def tree(ds: OsmDataset) -> DataFrame:
    """kind, level, node, n, h1, h2: the leaves (level 0) and all nodes above."""
    out = None
    for kind in KINDS:
        df = getattr(ds, kind)
        text = F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(_content(df)))))
        wide = lambda h: h.cast("decimal(20,0)")
        rows = df.select(F.lit(kind).alias("kind"), F.shiftright("id", LEAF).alias("node"), wide(F.xxhash64(text)).alias("h1"), wide(F.xxhash64(F.lit(1), text)).alias("h2"))
        leaves = rows.groupBy("kind", "node").agg(F.count(F.lit(1)).alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))
        out = leaves if out is None else out.unionByName(leaves)
    ups = F.explode(F.array(*(F.struct(F.lit(level).alias("level"), F.shiftright("node", FAN * level).alias("node")) for level in range(LEVELS)))).alias("u")
    sums = out.select("kind", ups, "n", "h1", "h2").groupBy("kind", "u.level", "u.node")
    return sums.agg(*(F.sum(c).cast("decimal(38,0)").alias(c) for c in ("n", "h1", "h2")))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """kind, node of leaves of two trees that differ: from the top, level by level, below nodes that do."""
    found = None
    for level in range(LEVELS - 1, -1, -1):
        x, y = (t.where(F.col("level") == level).drop("level") for t in (a, b))
        if found is not None:
            parent = F.shiftright("node", FAN)
            x, y = (t.withColumn("parent", parent).join(found.withColumnRenamed("node", "parent"), ["kind", "parent"], "left_semi").drop("parent") for t in (x, y))
        met = x.select("kind", "node", F.struct("n", "h1", "h2").alias("x")).join(y.select("kind", "node", F.struct("n", "h1", "h2").alias("y")), ["kind", "node"], "full")
        found = cut(met.where(~F.col("x").eqNullSafe(F.col("y"))).select("kind", "node"))
        if found.isEmpty():
            break
    return found


def differences(a: OsmDataset, b: OsmDataset, tree_a: DataFrame | None = None, tree_b: DataFrame | None = None) -> DataFrame:
    """kind, side, id of rows of either dataset that the other lacks, repeated as often as they are more. Trees that are kept spare a pass."""
    leaves = differing(tree_a if tree_a is not None else cut(tree(a)), tree_b if tree_b is not None else cut(tree(b)))
    out = a.spark.createDataFrame([], "kind string, side string, id bigint")
    kinds = {r["kind"] for r in leaves.select("kind").distinct().collect()}  # others have nothing to look at
    for kind in (k for k in KINDS if k in kinds):
        own = leaves.where(F.col("kind") == kind).select("node")
        x, y = (df.withColumn("tags", F.coalesce("tags", no_tags())).withColumn("node", F.shiftright("id", LEAF)).join(own, "node", "left_semi").drop("node") for df in (getattr(a, kind), getattr(b, kind)))
        x, y = cut(x), cut(y.select(*x.columns))  # the rows of differing leaves, each compared twice
        for side, d in (("left", x.exceptAll(y)), ("right", y.exceptAll(x))):
            rows = d.select(F.lit(kind).alias("kind"), F.lit(side).alias("side"), "id")
            out = out.unionByName(rows)
    return out

"""Merkle manifest of a dataset: a digest of each row, of each source and of the whole, and a proof for each row.

Nodes of a group stand in order; every FAN consecutive ones become the digest of their digests, level by level, until one remains. The nodes
are cut at multiples of FAN ** HEIGHT into blocks. A task traverses a block in postorder: a subtree returns its digest, and while the
recursion unwinds, the digests beside it are appended to the paths of the leaves that it contains. Blocks are aligned, so their roots are the
nodes of the same tree HEIGHT levels higher, and go through another distributed traversal, until each group has one root. Rows are such
nodes in the group of their source; the sources' roots are nodes of a single group.

A path is an array of (before, after): the digests left and right of the node, concatenated, a pair for each level; both empty where
a run has one node. With it a leaf is folded to the root, or the proof written, in one expression.

Defined results: every null column of a row counts as `-`, an empty text as `0:`. Rows are ordered by doc_id, a null one first, then by digest, so that
rows repeated, whose digests are equal, may change places. Very long texts are hashed whole where they are read; only digests are shuffled. An
empty table gives an empty result; a single row is its own root, with a proof of no siblings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .heavy import join_counted
from .scratch import stash

FAN = 3
HEIGHT = 7  # 2,187 nodes a block
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"
_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest_of(*columns: Column) -> Column:
    """sha256 of the columns: - for a null, else the UTF-8 bytes of the value, counted, a colon, and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in texts)), 256)


def traverse(nodes: list[str], height: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root that nodes have after `height` levels, and the path of each node to it."""
    paths: list[list[tuple[str, str]]] = [[] for _ in nodes]

    def subtree(at: int, level: int) -> str:
        if level == 0:
            return nodes[at]
        width = FAN ** (level - 1)
        starts = range(at, min(at + FAN * width, len(nodes)), width)
        below = [subtree(s, level - 1) for s in starts]
        for i, s in enumerate(starts):
            beside = ("".join(below[:i]), "".join(below[i + 1 :]))
            for leaf in range(s, min(s + width, len(nodes))):
                paths[leaf].append(beside)
        return hashlib.sha256("".join(below).encode()).hexdigest()

    return subtree(0, height), paths


def levels_of(n: int) -> int:
    """Levels until one of n nodes remains."""
    height = 0
    while FAN**height < n:
        height += 1
    return height


def _block(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
    block = block.sort_by("place")
    # A lone block ends with its group's root; others always climb the whole height, so that their roots are nodes of one level.
    root, paths = traverse(block["digest"].to_pylist(), min(HEIGHT, levels_of(block["n"][0].as_py())))
    told = pa.array([[{"before": b, "after": a} for b, a in p] for p in paths], _PATH)
    return block.drop_columns(["digest", "block"]).append_column("path", told).append_column("root", pa.array([root] * len(paths), pa.string()))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each row in its group, within the partition."""
    last, at = None, 0
    for b in batches:
        places = []
        for g in b.column("grp").to_pylist():
            last, at = (g, at + 1) if g == last else (g, 0)
            places.append(at)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.int64())], names=[*b.schema.names, "within"])


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *more])


def _ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with place (from 0 in the group, by order) and n (nodes of the group). Ranges are cut wherever rows are many, also within a group."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = nodes.repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order).withColumn("part", F.spark_partition_id())
    by = stash(by.mapInArrow(_number, _schema(by, "within long")), "ranges")
    counts = by.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("c"))  # a row for each group, and one more for each range border
    w = Window.partitionBy("grp")
    starts = counts.select("grp", "part", F.coalesce(F.sum("c").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("c").over(w).alias("n"))
    return by.join(starts, ["grp", "part"]).withColumn("place", F.col("start") + F.col("within")).drop("start", "within", "part")


def tree(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """nodes: grp (not null), digest, carry, and the columns of order. Gives grp, carry and path (to the group's root) of each; and grp, root of each group."""
    width = FAN**HEIGHT
    block = F.floor(F.col("place") / width)
    now, steps, roots = _ranked(nodes, order).select("grp", "place", "n", "digest", "carry"), [], None
    while True:
        dealt = now.withColumn("block", block)
        steps.append(stash(dealt.groupBy("grp", "block").applyInArrow(_block, _schema(dealt.drop("digest", "block"), f"path {PATH}", "root string")), "paths"))
        up = steps[-1].groupBy("grp", block.alias("place")).agg(F.ceil(F.first("n") / width).alias("n"), F.first("root").alias("digest"))  # alike in a block
        ended = up.where("n = 1").select("grp", F.col("digest").alias("root"))
        roots = ended if roots is None else roots.unionByName(ended)
        now = stash(up.where("n > 1"), "nodes")
        if now.isEmpty():
            break
    paths = steps[-1]
    for below in reversed(steps[:-1]):
        above = paths.select("grp", F.col("place").alias("block"), F.col("path").alias("above"))
        joined = below.withColumn("block", block).join(above, ["grp", "block"], "left")
        paths = joined.withColumn("path", F.concat("path", F.coalesce("above", F.array().cast(PATH)))).drop("above", "block")
    return paths.select("grp", "carry", "path"), roots


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf has with the siblings of a path."""
    return F.aggregate(path, leaf, lambda node, p: F.sha2(F.concat(p["before"], node, p["after"]), 256))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, in order."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def manifest(docs: DataFrame, again: Column | None = None) -> DataFrame:
    """Of each row doc_id, leaf, again (the digest in the column given, else leaf), subroot, root, path."""
    named = {c: F.col(f"`{c}`") for c in COLUMNS}
    leaf = digest_of(*named.values())
    source = named["source"].cast("string")
    # Written first, so that a row keeps its number when a task runs again.
    carry = F.struct(named["doc_id"].alias("doc_id"), leaf.alias("leaf"), (leaf if again is None else again).alias("again"))
    grp = F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))
    leaves = stash(docs.select(grp.alias("grp"), carry.alias("carry"), F.monotonically_increasing_id().alias("number")).withColumn("digest", F.col("carry.leaf")).withColumn("doc_id", F.col("carry.doc_id")), "leaves")
    paths, subroots = tree(leaves, ["doc_id", "digest", "number"])
    named_roots = stash(subroots.select(F.lit("").alias("grp"), F.col("root").alias("digest"), F.col("grp").alias("name"), F.struct(F.col("grp").alias("name"), F.col("root").alias("subroot")).alias("carry")), "subroots")
    above, top = tree(named_roots, ["name"])
    root = top.first()  # one digest
    sizes = leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"))
    upper = stash(above.select(F.col("carry.name").alias("grp"), F.col("carry.subroot").alias("subroot"), F.col("path").alias("upper")).join(sizes, "grp"), "upper")
    joined = join_counted(paths, upper, ["grp"], "rows", upper.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    return joined.select("carry.*", "subroot", F.lit(root["root"] if root else None).cast("string").alias("root"), F.concat("path", "upper").alias("path"))


def verify(docs: DataFrame, tampered: Column, where: Column) -> DataFrame:
    """Each row's digests and proof, and whether the row, with another text (a column) where it was tampered with (a condition), folds to the root by its old siblings."""
    leaf, other = (digest_of(*(text if c == "text" else F.col(f"`{c}`") for c in COLUMNS)) for text in (F.col("text"), tampered))
    out = manifest(docs, F.when(where, other).otherwise(leaf))
    out = out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.col("again"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

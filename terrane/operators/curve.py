"""A space-filling curve over tiles: Morton keys, boxes as intervals of keys, a stored index that reads few files, and a pyramid of tiles.

The key of a tile interleaves the bits of its x and y, so a square of tiles whose side is a power of two, and aligned, is one interval of keys, and a key
without its last two bits is that of the tile one zoom further out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Steps of spreading 32 bits apart, each with the bits that stay: fixed values.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(n: Column) -> Column:
    n = n.cast("long")
    for shift, mask in SPREAD:
        n = (n.bitwiseOR(F.shiftleft(n, shift))).bitwiseAND(F.lit(mask))
    return n


def _gather(n: Column) -> Column:
    n = n.bitwiseAND(F.lit(SPREAD[-1][1]))
    for shift, mask in [*((s, m) for (s, _), (_, m) in zip(SPREAD[::-1], SPREAD[-2::-1])), (16, 0xFFFFFFFF)]:
        n = n.bitwiseOR(F.shiftright(n, shift)).bitwiseAND(F.lit(mask))
    return n


def key(x: Column, y: Column) -> Column:
    """Morton key of a tile, x in the lower of two bits; x and y under 2 ** 31."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def x_of(k: Column) -> Column:
    return _gather(k).cast("int")


def y_of(k: Column) -> Column:
    return _gather(F.shiftright(k, 1)).cast("int")


def intervals(x0: int, y0: int, x1: int, y1: int, zoom: int, most: int = 64) -> list[tuple[int, int]]:
    """Intervals of keys, both ends included, of the tiles from x0, y0 to x1, y1. Over `most`, those next to each other with the smallest gaps become one,
    which then holds tiles outside too."""
    out: list[tuple[int, int]] = []

    def square(x: int, y: int, side: int, first: int) -> None:
        if x > x1 or y > y1 or x + side <= x0 or y + side <= y0:
            return
        if x0 <= x and y0 <= y and x + side - 1 <= x1 and y + side - 1 <= y1:
            if out and out[-1][1] == first - 1:
                out[-1] = (out[-1][0], first + side * side - 1)
            else:
                out.append((first, first + side * side - 1))
            return
        half = side // 2
        for i, (dx, dy) in enumerate(((0, 0), (half, 0), (0, half), (half, half))):
            square(x + dx, y + dy, half, first + i * half * half)

    square(0, 0, 1 << zoom, 0)
    while len(out) > most:
        gap = min(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1])
        out[gap - 1 : gap + 1] = [(out[gap - 1][0], out[gap][1])]
    return out


def in_range(column: str, x0: int, y0: int, x1: int, y1: int, zoom: int) -> Column:
    """Whether a key is of a tile from x0, y0 to x1, y1: intervals, which a scan can push down, and then exactly."""
    k = F.col(column)
    near = F.lit(False)
    for low, high in intervals(x0, y0, x1, y1, zoom):
        near = near | k.between(low, high)
    return near & x_of(k).between(x0, x1) & y_of(k).between(y0, y1)


def write_index(index: DataFrame, path: str, files: int | None = None) -> None:
    """index: xtile, ytile, way_id. Files are ranges of keys, sorted, so that each file and row group spans few tiles."""
    keyed = index.select(key(F.col("xtile"), F.col("ytile")).alias("key"), "way_id")
    n = files or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed.repartitionByRange(n, "key").sortWithinPartitions("key", "way_id").write.parquet(path)


def read_index(spark, path: str, x0: int, y0: int, x1: int, y1: int, zoom: int = 12) -> DataFrame:
    """xtile, ytile, way_id of the tiles asked for."""
    if x0 > x1 or y0 > y1:
        raise ValueError(f"not a tile range: {x0},{y0} to {x1},{y1}")
    rows = spark.read.schema("key bigint, way_id bigint").parquet(path).where(in_range("key", x0, y0, x1, y1, zoom))
    return rows.select(x_of(F.col("key")).alias("xtile"), y_of(F.col("key")).alias("ytile"), "way_id")


def pyramid(keys: DataFrame, zoom: int, most: int) -> DataFrame:
    """keys: a column key of tiles at a zoom. Leaves of an adaptive quadtree: tiles are split while they hold over `most` rows and are not of the
    last zoom. Gives zoom, xtile, ytile, n.

    Rows are counted once, by tile; all coarser zooms come from these counts in one grouping.
    """
    cells = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    levels = F.explode(F.array(*(F.struct(F.lit(z).alias("zoom"), F.shiftright("key", 2 * (zoom - z)).alias("key")) for z in range(zoom + 1)))).alias("t")
    tiles = cells.select(levels, "n").groupBy("t.zoom", "t.key").agg(F.sum("n").alias("n"))
    # A tile is a leaf if it is not split and its parent is.
    parents = tiles.where(F.col("n") > most).select((F.col("zoom") + 1).alias("zoom"), F.col("key").alias("parent"))
    below = tiles.where((F.col("n") <= most) | (F.col("zoom") == zoom)).withColumn("parent", F.shiftright("key", 2))
    leaves = below.where("zoom > 0").join(parents, ["zoom", "parent"], "left_semi").unionByName(below.where("zoom = 0"))
    return leaves.select("zoom", x_of(F.col("key")).alias("xtile"), y_of(F.col("key")).alias("ytile"), "n")

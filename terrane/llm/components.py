"""Connected components of a graph of ids, by alternating large and small stars; every step is a shuffle of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, stash


HUB = 1000  # neighbours that one task meets
HUBS = 10_000  # nodes of more neighbours that may be told to all tasks


def _to_least(edges: DataFrame, least: DataFrame, hub: int | None) -> DataFrame:
    """edges (u, v) with the least m of each u. least: u, m, n (neighbours). A hub's edges are dealt to as many tasks as it takes."""
    if hub is None:
        return edges.join(least.drop("n"), "u")
    hubs = F.broadcast(least.where(F.col("n") > hub).select("u", F.ceil(F.col("n") / hub).cast("int").alias("tasks")))
    salt = lambda df, x: df.join(hubs, "u", "left").withColumn("salt", x(F.coalesce("tasks", F.lit(1)))).drop("tasks")
    return salt(edges, lambda n: F.pmod(F.xxhash64("v"), n).cast("int")).join(salt(least.drop("n"), lambda n: F.explode(F.sequence(F.lit(0), n - 1))), ["u", "salt"]).drop("salt")


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _hub(edges: DataFrame) -> int | None:
    """From how many neighbours on a node is a hub; None if no node is. Fewer than HUBS nodes have as many, whatever the input."""
    total, most = _both(edges).groupBy("u").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    hub = max(HUB, -(-total // HUBS))
    return hub if most > hub else None


def _large_star(edges: DataFrame, hub: int | None) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbourhood."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _to_least(both.where("v > u"), least, hub).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, hub: int | None) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return _to_least(down, least, hub).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long, u <> v). Each node that has an edge, but for the least of its component: u, and v, that least."""
    now = stash(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    said = None
    while True:
        hub = _hub(now)
        new = stash(_small_star(_large_star(now, hub), hub).distinct(), "edges")
        drop(now)
        now = new
        # Stars are the end: nobody has two least neighbours, and no least one has a lesser.
        if now.groupBy("u").count().where("count > 1").isEmpty() and now.select(F.col("v").alias("u")).distinct().join(now, "u", "left_semi").isEmpty():
            return now
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == said:
            return now
        said = mark

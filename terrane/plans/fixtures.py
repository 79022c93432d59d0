"""OSM-shaped views over the driver's tables, as SQL that both engines take: {table} stands for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import no_tags, tag
from ..model import MEMBERS, TAGS, OsmDataset
from ..sources import folders

TABLES = ("orders", "lineitem", "part", "customer", "nation", "region", "events")

VIEWS = {
    "way_refs": """SELECT way_id, CAST(row_number() OVER (PARTITION BY way_id ORDER BY pos, node_id) - 1 AS INT) AS pos, node_id FROM (
 SELECT l_orderkey AS way_id, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS pos, l_partkey * 100000 + l_suppkey AS node_id FROM {lineitem}
 UNION ALL
 SELECT way_id, 900000000000000000 AS pos, node_id FROM (SELECT l_orderkey AS way_id, l_partkey * 100000 + l_suppkey AS node_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM {lineitem}) f WHERE rn = 1 AND way_id % 4 = 0) u""",
    "nodes": """SELECT node_id, CAST(450000000 + (node_id * 7919) % 10000000 AS INT) AS fixed_lat, CAST(-1230000000 + (node_id * 104729) % 10000000 AS INT) AS fixed_lon
 FROM (SELECT DISTINCT node_id FROM way_refs UNION SELECT p_partkey * 100000 + 99999 FROM {part}) n""",
    "ways": """SELECT o_orderkey AS way_id, o_custkey, lower(substr(o_orderpriority, 3)) AS highway, CASE WHEN o_orderstatus = 'F' THEN 'yes' END AS building, concat('Order ', CAST(o_orderkey AS VARCHAR(20))) AS name
 FROM {orders} WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem})""",
    "members": """SELECT 1000000000 + o_custkey AS relation_id, 'WAY' AS mtype, way_id AS member_id, CASE WHEN way_id % 4 = 0 THEN 'outer' ELSE '' END AS mrole FROM ways
 UNION ALL SELECT 1000000000 + w.o_custkey, 'NODE', r.node_id, 'label' FROM (SELECT o_custkey, min(way_id) AS way_id FROM ways GROUP BY 1) w JOIN way_refs r ON r.way_id = w.way_id AND r.pos = 0
 UNION ALL SELECT 2000000000 + CAST(c_nationkey AS BIGINT), 'RELATION', 1000000000 + c_custkey, 'subarea' FROM {customer}
 UNION ALL SELECT 3000000000 + CAST(n_regionkey AS BIGINT), 'RELATION', 2000000000 + CAST(n_nationkey AS BIGINT), 'subarea' FROM {nation}
 UNION ALL SELECT 3000000000, 'RELATION', 3000000000, 'self' FROM {region} WHERE r_regionkey = 0""",
}
TILE = {
    "x": "CAST(floor(({lon} + 180) / 360 * 4096) AS INT)",
    "y": "CAST(floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * 4096) AS INT)",
}
INDEX = f"""SELECT w.way_id, {TILE['x'].format(lon='(n.fixed_lon / 1e7)')} AS xtile, {TILE['y'].format(lat='(n.fixed_lat / 1e7)')} AS ytile
 FROM ways w JOIN way_refs r ON r.way_id = w.way_id AND r.pos = 0 JOIN nodes n ON n.node_id = r.node_id"""
#: min lat, min lon, max lat, max lon
BOX = (45.2, -122.8, 45.4, -122.6)
BOX_SQL = f"xtile BETWEEN {TILE['x'].format(lon='-122.8e0')} AND {TILE['x'].format(lon='-122.6e0')} AND ytile BETWEEN {TILE['y'].format(lat='45.4e0')} AND {TILE['y'].format(lat='45.2e0')}"


def ctes(*more: str, recursive: bool = False) -> str:
    """WITH clause for the oracle; more: further CTEs."""
    names = {t: t for t in TABLES}
    parts = [f"{n} AS ({q.format(**names)})" for n, q in VIEWS.items()] + [f"tile_index AS ({INDEX})", f"ext_ways AS (SELECT way_id FROM tile_index WHERE {BOX_SQL})", *more]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PIECE = 4 << 20  # bytes of the tables' files for each partition of a view
KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "part": "p_partkey * 100000 + 99999"}  # as the views have ways and nodes


def pieces(spark: SparkSession, sf_dir: str) -> int:
    """In how many partitions views are dealt: in proportion to the tables, so that a task's share does not grow with them."""
    size = sum(folders.size(spark, f"{sf_dir}/{t}.parquet") for t in TABLES)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PIECE))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views, dealt by way or, for nodes, by node."""
    need = {"way_refs": ("way_refs",), "nodes": ("nodes",), "ways": ("ways",), "members": ("way_refs", "ways", "members")}[name]
    query = "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in need) + f" SELECT * FROM {name}"
    n = pieces(spark, sf_dir)
    frames = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in query}
    frames = {t: f.repartition(n, F.expr(KEYS[t])) if t in KEYS else f for t, f in frames.items()}
    if name == "nodes":  # the view takes its references as a table, so that they can be dealt
        query = query.replace(" way_refs ", " {way_refs} ")
        frames["way_refs"] = view(spark, sf_dir, "way_refs").select("node_id").repartition(n, "node_id")
    return spark.sql(query, **frames)


def dataset(spark: SparkSession, sf_dir: str) -> OsmDataset:
    """The views as entities, each from one aggregate over what it is made of: no window, and no table shuffled twice."""
    n = pieces(spark, sf_dir)
    dealt = lambda t: table(spark, sf_dir, t).repartition(n, F.expr(KEYS[t]))
    at = "l_partkey * 100000 + l_suppkey"
    ids = table(spark, sf_dir, "lineitem").selectExpr(f"{at} AS id").union(table(spark, sf_dir, "part").selectExpr(f"{KEYS['part']} AS id"))
    nodes = ids.repartition(n, "id").distinct().selectExpr("id", "CAST(450000000 + (id * 7919) % 10000000 AS INT) AS fixed_lat", "CAST(-1230000000 + (id * 104729) % 10000000 AS INT) AS fixed_lon")
    lines = dealt("lineitem").selectExpr("l_orderkey AS way_id", f"struct(l_linenumber * 1000000000000 + {at} AS pos, {at} AS node_id) AS ref", "struct(l_linenumber, l_partkey, l_suppkey) AS line").groupBy("way_id")
    first = F.min("line").alias("first")
    again = F.expr(f"struct(900000000000000000 AS pos, {at.replace('l_', 'first.l_')} AS node_id)")  # a ring's first node
    ring = F.col("way_id") % 4 == 0
    refs = lines.agg(F.collect_list("ref").alias("refs"), first).withColumn("refs", F.when(ring, F.array_append("refs", again)).otherwise(F.col("refs")))
    orders = dealt("orders").withColumnRenamed("o_orderkey", "way_id")
    w = orders.selectExpr("way_id", "lower(substr(o_orderpriority, 3)) AS highway", "CASE WHEN o_orderstatus = 'F' THEN 'yes' END AS building", "concat('Order ', CAST(way_id AS STRING)) AS name")
    tags = F.filter(F.array(tag("highway", F.col("highway")), F.when(F.col("building").isNotNull(), tag("building", F.col("building"))), tag("name", F.col("name"))), lambda t: t.isNotNull()).cast(TAGS)
    ways = w.join(refs, "way_id").select(F.col("way_id").alias("id"), F.transform(F.sort_array("refs"), lambda r: r["node_id"]).alias("nodes"), tags.alias("tags"))
    starts = lines.agg(F.min("ref").alias("ref"), first).select("way_id", F.when(ring, F.least("ref", again)).otherwise(F.col("ref"))["node_id"].alias("node_id"))
    held = orders.select("way_id", "o_custkey").join(starts, "way_id").selectExpr("1000000000 + o_custkey AS relation_id", "struct('WAY' AS type, way_id AS id, CASE WHEN way_id % 4 = 0 THEN 'outer' ELSE '' END AS role) AS m", "struct(way_id, node_id) AS label")
    inner = lambda t, own, id_, role="subarea": table(spark, sf_dir, t).selectExpr(f"{own} AS relation_id", f"struct('RELATION' AS type, {id_} AS id, '{role}' AS role) AS m")
    areas = inner("customer", "2000000000 + CAST(c_nationkey AS BIGINT)", "1000000000 + c_custkey")
    areas = areas.union(inner("nation", "3000000000 + CAST(n_regionkey AS BIGINT)", "2000000000 + CAST(n_nationkey AS BIGINT)"))
    areas = areas.union(inner("region", "3000000000", "3000000000", "self").where("r_regionkey = 0"))
    told = held.unionByName(areas, allowMissingColumns=True).repartition(n, "relation_id").groupBy("relation_id").agg(F.collect_list("m").alias("m"), F.min("label").alias("label"))
    label = F.expr("struct('NODE' AS type, label.node_id AS id, 'label' AS role)")  # of a customer: the first node of the least way
    m = F.sort_array(F.when(F.col("label").isNotNull(), F.array_append("m", label)).otherwise(F.col("m")))
    relations = told.select(F.col("relation_id").alias("id"), m.cast(MEMBERS).alias("members"), no_tags().alias("tags"))
    return OsmDataset.of(nodes.withColumn("tags", no_tags()), ways, relations)


def publish(changes: DataFrame, base: str, scale: str = "minute") -> None:
    """A replication server's folder with a diff for each seq of node changes, dated a day apart; base is a path that all executors open."""
    import gzip
    import os

    from ..streaming.updater import path_of

    def element(r) -> str:
        half = lambda n: f"{(n + (0.5 if n >= 0 else -0.5)) / 1e7:.8f}"  # noqa: E731  degrees are cut to whole units when they are read
        return f'<node id="{r.id}"/>' if r.op == "delete" else f'<node id="{r.id}" lat="{half(r.fixed_lat)}" lon="{half(r.fixed_lon)}"/>'

    def write(pdf):
        seq = int(pdf["seq"].iloc[0])
        body = "".join(f"<{tag}>{element(r)}</{tag}>" for r in pdf.sort_values("ord").itertuples() for tag in ("delete" if r.op == "delete" else "modify",))
        at = f"{base}/{scale}/{path_of(seq)}"
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(f"{at}.osc.gz", "wb") as f:
            f.write(gzip.compress(f"<osmChange>{body}</osmChange>".encode()))
        return pdf[["seq"]].head(1)

    changes.where("type = 'NODE'").groupBy("seq").applyInPandas(write, "seq bigint").count()


def publish_states(base: str, sequences: list[int], scale: str = "minute") -> None:
    """State files of diffs, and that of the last one as the server's state."""
    import os
    from datetime import datetime, timezone

    from ..streaming.updater import path_of

    for n in sequences:
        at = f"{base}/{scale}/{path_of(n)}.state.txt"
        os.makedirs(os.path.dirname(at), exist_ok=True)
        text = f"sequenceNumber={n}\ntimestamp={datetime.fromtimestamp(day(n), timezone.utc):%Y-%m-%dT%H\\:%M\\:%SZ}\n"
        for where in (at, f"{base}/{scale}/state.txt"):
            with open(where, "w") as f:
                f.write(text)


def day(n: int) -> int:
    """The timestamp of the n-th diff: the end of the n-th day of 2024."""
    return 1704067200 + 86400 * n

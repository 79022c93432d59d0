"""Registered queries of text forms, guards, sets, comparison and stored forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags, text, tiles
from ..model import OsmDataset
from ..operators import analyze, changes, digests, enrich, extract, idsets, segments
from ..sources import files, folders, formats, osmchange
from ..sources.sink import EntitySink, send
from ..streaming import updater
from . import fixtures
from .catalogue import _CLOSED, _EXTRACTED, _LAST, node_changes, query
from .fixtures import BOX, ctes, dataset, table


# ---- text forms and guards ----


@query("SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN n > 1000000 THEN (n + 50000) // 1000000 || '.' || (n + 50000) // 100000 % 10 || 'M' WHEN n > 1000 THEN (n // 1000) || 'k' ELSE CAST(n AS VARCHAR) END AS said FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_orderkey * l_linenumber * 97 AS n FROM lineitem) t")
def human_counts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line")).distinct()
    return n.select("id", "line", text.human_count(F.col("id") * F.col("line") * 97).alias("said"))


@query("SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS said FROM events")
def epoch_texts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), text.epoch_text(F.unix_millis(F.col("ts").cast("timestamp"))).alias("said"))


@query(ctes() + "SELECT node_id AS id, '[Node ' || CAST(fixed_lat / 1e7 AS DOUBLE) || ' ' || CAST(fixed_lon / 1e7 AS DOUBLE) || ']' AS said FROM nodes")
def node_texts(spark: SparkSession, d: str) -> DataFrame:
    return dataset(spark, d).nodes.select("id", text.node_text().alias("said"))


@query(
    ctes()
    + "SELECT relation_id AS id, 'relation with tags []' || chr(10) || string_agg('  ' || mtype || ' ' || member_id || CASE WHEN mrole <> '' THEN ' as ' || mrole ELSE '' END || chr(10), '' ORDER BY mtype, member_id, mrole) || chr(10) AS said FROM members GROUP BY 1"
)
def relation_texts(spark: SparkSession, d: str) -> DataFrame:
    return dataset(spark, d).relations.select("id", text.relation_text().alias("said"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, printf('%.1f kph', max(CAST(l_orderkey * 7 + l_linenumber * 3 AS DOUBLE) / 8)) AS said FROM lineitem WHERE (l_orderkey * 7 + l_linenumber * 3) * 10 % 8 <> 4 GROUP BY 1, 2")
def speed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Eighths, but for those that end in a half of a tenth, where engines round differently."""
    n = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().where(n * 10 % 8 != 4)
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), text.speed_text(n.cast("double") / 8).alias("said"))


@query(
    ctes()
    + "SELECT way_id AS id, building IS NULL AS as_before, CAST(CASE WHEN building IS NULL THEN 1 ELSE 0 END AS INT) AS same_texts FROM ways"
)
def tags_compared(spark: SparkSession, d: str) -> DataFrame:
    """A way's tags against the same without buildings': equal only in full and in order."""
    ways = dataset(spark, d).ways
    other = F.filter("tags", lambda t: t["key"] != "building")
    return ways.select("id", tags.tags_equal(F.col("tags"), other).alias("as_before"), (text.tags_text(F.col("tags")) == text.tags_text(other)).cast("int").alias("same_texts"))


@query(ctes() + f"SELECT node_id AS id, z AS zoom, CAST(floor((fixed_lon / 1e7 + 180) / 360 * (1 << z)) AS INT) AS xtile, CAST(floor((1 - ln(tan(radians(fixed_lat / 1e7)) + 1 / cos(radians(fixed_lat / 1e7))) / pi()) / 2 * (1 << z)) AS INT) AS ytile FROM (SELECT *, CAST(node_id % 19 AS INT) AS z FROM nodes)")
def tiles_at_zooms(spark: SparkSession, d: str) -> DataFrame:
    """Each node's tile at a zoom of its own, 0 to 18."""
    n = dataset(spark, d).nodes.withColumn("zoom", (F.col("id") % 19).cast("int"))
    lat, lon = tiles.degrees(F.col("fixed_lat")), tiles.degrees(F.col("fixed_lon"))
    return n.select("id", "zoom", tiles.x_tile(lon, F.col("zoom")).alias("xtile"), tiles.y_tile(lat, F.col("zoom")).alias("ytile"))


@query(
    "SELECT l_orderkey AS id, l_linenumber AS line, bool_and(a >= -90 AND a < c AND c <= 90 AND b >= -180 AND b < e AND e <= 180) AS is_box FROM (SELECT l_orderkey, l_linenumber, l_linenumber * 40 - 140 AS a, l_orderkey % 400 - 200 AS b, l_linenumber * 30 - 100 AS c, l_orderkey % 390 - 190 AS e FROM lineitem) t GROUP BY 1, 2"
)
def boxes_checked(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line")).distinct()
    return k.select("id", "line", tiles.is_box(F.col("line") * 40 - 140, F.col("id") % 400 - 200, F.col("line") * 30 - 100, F.col("id") % 390 - 190).alias("is_box"))


@query("SELECT event_id AS id, t BETWEEN 1430438400 AND 4105123200 AS plausible FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) * (event_id % 4) AS t FROM events) e")
def times_checked(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), updater.plausible(F.unix_seconds(F.col("ts").cast("timestamp")) * (F.col("event_id") % 4)).alias("plausible"))


# ---- sets and comparison ----

_SETS = "a AS (SELECT DISTINCT node_id AS id FROM way_refs r JOIN ways w ON w.way_id = r.way_id WHERE building IS NULL), b AS (SELECT DISTINCT node_id AS id FROM way_refs r JOIN ways w ON w.way_id = r.way_id WHERE highway = 'urgent')"


@query(
    ctes(_SETS)
    + """SELECT 'either' AS operation, id FROM (SELECT id FROM a UNION SELECT id FROM b) UNION ALL SELECT 'both', id FROM a WHERE id IN (SELECT id FROM b)
 UNION ALL SELECT 'without', id FROM a WHERE id NOT IN (SELECT id FROM b)"""
)
def id_set_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of ways that are no buildings, and of urgent ways: compressed sets, combined."""
    ds = dataset(spark, d)
    a = idsets.build(analyze.referenced_nodes(ds.ways), "node_id")
    b = idsets.build(ds.ways.where(tags.has_tag(F.col("tags"), "highway", "urgent")).select(F.explode("nodes").alias("id")), "id")
    named = lambda name, held: idsets.ids_of(held).select(F.lit(name).alias("operation"), "id")
    return named("either", idsets.either(a, b)).unionByName(named("both", idsets.both(a, b))).unionByName(named("without", idsets.without(a, b)))


@query(ctes(_SETS) + "SELECT n.node_id AS id, a.id IS NOT NULL AS inside, count(a.id) OVER (ORDER BY n.node_id) AS rank FROM nodes n LEFT JOIN a ON a.id = n.node_id")
def id_set_ranks(spark: SparkSession, d: str) -> DataFrame:
    ds = dataset(spark, d)
    return idsets.ranks(idsets.build(analyze.referenced_nodes(ds.ways), "node_id"), ds.nodes, "id")


@query(
    ctes(_LAST, "c AS (SELECT n.node_id AS id, n.fixed_lat AS lat, n.fixed_lon AS lon, l.op, l.fixed_lat AS new_lat FROM last_change l LEFT JOIN nodes n USING (node_id))")
    + """SELECT 'nodes' AS kind, 'left' AS side, id FROM c WHERE id IS NOT NULL AND (op = 'delete' OR lat <> new_lat OR lon <> -1230000000)
 UNION ALL SELECT 'nodes', 'right', l.node_id FROM last_change l LEFT JOIN nodes n USING (node_id) WHERE l.op = 'upsert' AND (n.node_id IS NULL OR n.fixed_lat <> l.fixed_lat OR n.fixed_lon <> -1230000000)"""
)
def dataset_differences(spark: SparkSession, d: str) -> DataFrame:
    """A dataset before and after changes, by trees of digests."""
    ds = dataset(spark, d)
    return digests.differences(ds, changes.apply_changes(ds, node_changes(spark, d)))


# ---- stored forms ----


@query(ctes(_EXTRACTED, _CLOSED, recursive=True) + "SELECT c.relation_id AS id, count(*) AS n_members FROM closed c JOIN members m ON m.relation_id = c.relation_id GROUP BY 1")
def stored_extract(spark: SparkSession, d: str) -> DataFrame:
    """The relations of a box, from a store and the index that it keeps."""
    path = folders.shared(spark, "store")
    segments.create(dataset(spark, d), path, ranges=16, parts=fixtures.pieces(spark, d))
    got = extract.extract(segments.load(spark, path), BOX, index=segments.load_index(spark, path))
    return got.relations.select("id", F.size("members").cast("long").alias("n_members"))


@query(ctes() + "SELECT node_id AS id, fixed_lat, fixed_lon FROM nodes WHERE node_id % 1000 = 1 OR node_id % 100000 = 99999")
def nodes_looked_up(spark: SparkSession, d: str) -> DataFrame:
    """Many ids at once, from the blocks of a folder of parts that may hold them."""
    path = folders.shared(spark, "vex").removeprefix("file://").removeprefix("file:")
    ds = dataset(spark, d)
    files.save_parts(OsmDataset(ds.nodes, ds.ways.limit(0), ds.relations.limit(0), ds.meta), path, "vex")
    asked = ds.nodes.where("id % 1000 = 1 or id % 100000 = 99999").select("id").unionByName(ds.nodes.select((-1 - F.col("id")).alias("id")))
    return formats.look_up(spark, f"{path}/nodes", "nodes", asked).select("id", "fixed_lat", "fixed_lon")


@query("SELECT seq, 1704067200 + 86400 * seq AS timestamp FROM (SELECT DISTINCT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS BIGINT) AS seq FROM events) e")
def states_read(spark: SparkSession, d: str) -> DataFrame:
    """State files of a server that has a diff for each day of events."""
    base = folders.shared(spark, "server").removeprefix("file://").removeprefix("file:")
    days = [r[0] for r in node_changes(spark, d).select("seq").distinct().collect()]  # one a day
    fixtures.publish_states(base, sorted(days))
    states = osmchange.read_states(spark, base).where(~F.col("path").endswith("/minute/state.txt"))
    return states.select("seq", "timestamp")


@query(ctes("s AS (SELECT l_orderkey AS way_id, max(l_quantity) AS speed FROM lineitem GROUP BY 1)") + "SELECT w.way_id AS id, CAST(CAST(s.speed AS INT) AS VARCHAR) || '.0 kph' AS speed FROM ways w JOIN s ON s.way_id = w.way_id")
def speeds_from_csv(spark: SparkSession, d: str) -> DataFrame:
    path = folders.shared(spark, "speeds")
    table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("speed_kph")).withColumnRenamed("l_orderkey", "way_id").write.option("header", True).csv(path)
    return enrich.set_speeds(dataset(spark, d).ways, enrich.read_speeds(spark, path)).select("id", tags.get_tag(F.col("tags"), "maxspeed:motorcar").alias("speed"))


_WEIGHTS = "s AS (SELECT unnest(['highway', highway, 'highway=' || highway, 'name', name, 'name=' || name]) AS string FROM ways UNION ALL SELECT unnest(['building', building, 'building=' || building]) FROM ways WHERE building IS NOT NULL)"


@query(ctes(_WEIGHTS) + "SELECT CAST(sum(length(string)) AS BIGINT) AS weight, string FROM s GROUP BY 2 HAVING sum(length(string)) > 20000")
def tag_weights_file(spark: SparkSession, d: str) -> DataFrame:
    """The file of heavy tags, read again."""
    path = folders.shared(spark, "weights")
    analyze.write_tag_weights(dataset(spark, d), path, 20_000)
    return spark.read.option("sep", "|").schema("weight bigint, string string").csv(path)


@query(ctes(_WEIGHTS) + "SELECT CAST(sum(length(string)) AS BIGINT) AS weight, string FROM s GROUP BY 2 HAVING sum(length(string)) > 100000")
def heavy_tag_weights(spark: SparkSession, d: str) -> DataFrame:
    return analyze.tag_weights(dataset(spark, d))


@query(ctes() + "SELECT 'nodes' AS kind, count(*) AS n, CAST(sum(node_id) AS BIGINT) AS ids FROM nodes UNION ALL SELECT 'ways', count(*), CAST(sum(way_id) AS BIGINT) FROM ways UNION ALL SELECT 'relations', count(*), CAST(sum(relation_id) AS BIGINT) FROM (SELECT DISTINCT relation_id FROM members)")
def entities_sent(spark: SparkSession, d: str) -> DataFrame:
    """A sink that a user might write: it counts what it is sent, part by part."""

    class Counts(EntitySink):
        parts: list[DataFrame] = []

        def _count(self, kind: str, df: DataFrame) -> None:
            self.parts = [*self.parts, df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))]

        def nodes(self, nodes: DataFrame) -> None:
            self._count("nodes", nodes)

        def ways(self, ways: DataFrame) -> None:
            self._count("ways", ways)

        def relations(self, relations: DataFrame) -> None:
            self._count("relations", relations)

    sink = Counts()
    send(dataset(spark, d), sink)
    return sink.parts[0].unionByName(sink.parts[1]).unionByName(sink.parts[2])


@query(ctes() + "SELECT CAST(row_number() OVER (ORDER BY node_id) AS BIGINT) AS place, node_id AS id FROM nodes")
def nodes_in_id_order(spark: SparkSession, d: str) -> DataFrame:
    """Nodes as a folder of parts gives them: the parts in order, each sorted. place is the number of those that come before, and one."""
    path = folders.shared(spark, "vex").removeprefix("file://").removeprefix("file:")
    ds = dataset(spark, d)
    files.save_parts(OsmDataset(ds.nodes, ds.ways.limit(0), ds.relations.limit(0), ds.meta), path, "vex", 4)
    rows = files.load_osm(spark, path).nodes.select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("within"))
    starts, at = [], 0
    for k, p in enumerate(formats.read_parts(f"{path}/nodes")):  # a row a part
        starts.append((k, at))
        at += p["count"]
    return rows.join(F.broadcast(spark.createDataFrame(starts, "part int, start bigint")), "part").select((F.col("start") + F.col("within") + 1).alias("place"), "id")

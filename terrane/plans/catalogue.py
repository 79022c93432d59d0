"""Registered queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import coding, tags, text, tiles
from ..model import MEMBERS, TAGS, OsmDataset, members, way_refs
from ..operators import analyze, changes, curve, enrich, extract, index, places
from ..sources import files, folders
from .fixtures import BOX, BOX_SQL, TILE, ctes, dataset, pieces, table, view

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- coordinates and tiles ----


@query(ctes() + "SELECT node_id AS id, fixed_lat / 1e7 AS lat, fixed_lon / 1e7 AS lon FROM nodes")
def node_latlon(spark: SparkSession, d: str) -> DataFrame:
    n = dataset(spark, d).nodes
    return n.select("id", tiles.degrees(F.col("fixed_lat")).alias("lat"), tiles.degrees(F.col("fixed_lon")).alias("lon"))


@query(ctes() + "SELECT node_id AS id, CAST(trunc(fixed_lat / 1e7 * 1e7) AS INT) AS fixed_lat, CAST(trunc(fixed_lon / 1e7 * 1e7) AS INT) AS fixed_lon FROM nodes")
def node_fixed(spark: SparkSession, d: str) -> DataFrame:
    n = node_latlon(spark, d)
    return n.select("id", tiles.fixed(F.col("lat")).alias("fixed_lat"), tiles.fixed(F.col("lon")).alias("fixed_lon"))


@query(ctes() + f"SELECT node_id AS id, {TILE['x'].format(lon='(fixed_lon / 1e7)')} AS xtile, {TILE['y'].format(lat='(fixed_lat / 1e7)')} AS ytile FROM nodes")
def node_tile(spark: SparkSession, d: str) -> DataFrame:
    n = node_latlon(spark, d)
    return n.select("id", tiles.x_tile(F.col("lon")).alias("xtile"), tiles.y_tile(F.col("lat")).alias("ytile"))


@query(
    ctes()
    + """SELECT xtile, ytile, round(xtile / 4096.0e0 * 360 - 180, 6) AS west, round(degrees(atan(sinh(pi() - 2 * pi() * (ytile + 1) / 4096.0e0))), 6) AS south, round(360 / 4096.0e0, 6) AS width,
 round(degrees(atan(sinh(pi() - 2 * pi() * ytile / 4096.0e0))) - degrees(atan(sinh(pi() - 2 * pi() * (ytile + 1) / 4096.0e0))), 6) AS height FROM (SELECT DISTINCT xtile, ytile FROM tile_index) t"""
)
def tile_bounds(spark: SparkSession, d: str) -> DataFrame:
    t = _index(dataset(spark, d)).select("xtile", "ytile").distinct()
    r = t.withColumn("r", tiles.rectangle(F.col("xtile"), F.col("ytile"), tiles.ZOOM))
    return r.select("xtile", "ytile", *(F.round(f"r.{c}", 6).alias(c) for c in ("west", "south", "width", "height")))


def _index(ds: OsmDataset) -> DataFrame:
    return index.tile_index(ds.ways, ds.nodes)


@query(ctes() + "SELECT w.way_id, n.node_id, n.fixed_lat, n.fixed_lon FROM ways w JOIN way_refs r ON r.way_id = w.way_id AND r.pos = 0 JOIN nodes n ON n.node_id = r.node_id")
def way_first_node(spark: SparkSession, d: str) -> DataFrame:
    ds = dataset(spark, d)
    return index.first_nodes(ds.ways, ds.nodes).select("way_id", "node_id", "fixed_lat", "fixed_lon")


@query(ctes() + "SELECT xtile, ytile, way_id FROM tile_index")
def way_tile_index(spark: SparkSession, d: str) -> DataFrame:
    return _index(dataset(spark, d))


# ---- references and sets ----


@query(ctes() + "SELECT way_id, pos, node_id FROM way_refs")
def way_refs_exploded(spark: SparkSession, d: str) -> DataFrame:
    return dataset(spark, d).way_refs()


_PLAIN = "way_refs r JOIN ways w ON w.way_id = r.way_id AND w.building IS NULL"


@query(ctes() + f"SELECT DISTINCT r.node_id FROM {_PLAIN}")
def referenced_nodes(spark: SparkSession, d: str) -> DataFrame:
    return analyze.referenced_nodes(dataset(spark, d).ways)


@query(ctes() + f"SELECT r.node_id FROM {_PLAIN} GROUP BY 1 HAVING count(*) > 1")
def intersection_nodes(spark: SparkSession, d: str) -> DataFrame:
    return analyze.intersection_nodes(dataset(spark, d).ways)


@query(ctes() + "SELECT count(DISTINCT node_id) AS n FROM way_refs")
def node_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return analyze.cardinality(dataset(spark, d).way_refs(), "node_id")


@query(ctes() + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM ways) AS ways, (SELECT count(DISTINCT relation_id) FROM members) AS relations")
def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    return dataset(spark, d).counts()


def _relations_by(kind: str):
    @query(ctes() + f"SELECT DISTINCT member_id, relation_id FROM members WHERE mtype = '{kind}'")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return analyze.relation_index(dataset(spark, d).relations, kind)

    name = f"relations_by_{kind.lower()}"
    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


for _kind in ("NODE", "WAY", "RELATION"):
    _relations_by(_kind)


@query(ctes() + "SELECT relation_id, count(*) AS n_members, count(*) FILTER (WHERE mtype = 'WAY') AS n_ways, string_agg(mtype || ' ' || member_id || CASE WHEN mrole <> '' THEN ' as ' || mrole ELSE '' END, ', ' ORDER BY mtype, member_id, mrole) AS said FROM members GROUP BY 1")
def member_texts(spark: SparkSession, d: str) -> DataFrame:
    r = dataset(spark, d).relations
    ways = F.size(F.filter("members", lambda m: m["type"] == "WAY")).cast("long")
    return r.select(F.col("id").alias("relation_id"), F.size("members").cast("long").alias("n_members"), ways.alias("n_ways"), F.array_join(F.transform("members", text.member_text), ", ").alias("said"))


# ---- tags ----


@query(ctes() + "SELECT way_id AS id, highway, building, name FROM ways")
def tag_get(spark: SparkSession, d: str) -> DataFrame:
    w = dataset(spark, d).ways.withColumn("tags", tags.add_tag(F.col("tags"), "name", "second"))
    return w.select("id", *(tags.get_tag(F.col("tags"), k).alias(k) for k in ("highway", "building", "name")))


@query(ctes() + "SELECT way_id AS id, building IS NOT NULL AS has_building, false AS has_bridge FROM ways")
def tag_has(spark: SparkSession, d: str) -> DataFrame:
    w = dataset(spark, d).ways
    return w.select("id", tags.has_tag(F.col("tags"), "building").alias("has_building"), tags.has_tag(F.col("tags"), "bridge").alias("has_bridge"))


@query(ctes() + "SELECT way_id AS id, highway = 'urgent' AS urgent, false AS second FROM ways")
def tag_has_value(spark: SparkSession, d: str) -> DataFrame:
    w = dataset(spark, d).ways.withColumn("tags", tags.add_tag(F.col("tags"), "name", "second"))
    return w.select("id", tags.has_tag(F.col("tags"), "highway", "urgent").alias("urgent"), tags.has_tag(F.col("tags"), "name", "second").alias("second"))


@query(ctes() + "SELECT way_id AS id, coalesce(building = 'yes', false) AS building, way_id % 3 = 0 AS oneway FROM ways")
def tag_true(spark: SparkSession, d: str) -> DataFrame:
    w = _oneway(dataset(spark, d).ways)
    return w.select("id", tags.tag_is_true(F.col("tags"), "building").alias("building"), tags.tag_is_true(F.col("tags"), "oneway").alias("oneway"))


@query(ctes() + "SELECT way_id AS id, false AS building, way_id % 3 = 1 AS oneway FROM ways")
def tag_false(spark: SparkSession, d: str) -> DataFrame:
    w = _oneway(dataset(spark, d).ways)
    return w.select("id", tags.tag_is_false(F.col("tags"), "building").alias("building"), tags.tag_is_false(F.col("tags"), "oneway").alias("oneway"))


def _oneway(ways: DataFrame) -> DataFrame:
    value = F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 2 == 0, "YES").otherwise("1")).when(F.col("id") % 3 == 1, F.when(F.col("id") % 2 == 0, "No").otherwise("0")).otherwise("maybe")
    return ways.withColumn("tags", tags.add_tag(F.col("tags"), "oneway", value))


@query(ctes() + "SELECT 'node' AS kind, count(*) AS n FROM nodes UNION ALL SELECT 'relation', count(DISTINCT relation_id) FROM members")
def untagged(spark: SparkSession, d: str) -> DataFrame:
    ds = dataset(spark, d)
    kinds = [("node", ds.nodes), ("way", ds.ways), ("relation", ds.relations)]
    all_ = None
    for k, df in kinds:
        one = df.where(tags.has_no_tags(F.col("tags"))).select(F.lit(k).alias("kind"))
        all_ = one if all_ is None else all_.unionByName(one)
    return all_.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(ctes() + "SELECT way_id AS id, 4 + CAST(building IS NOT NULL AS INT) AS n, highway, '' AS empty, 'a=b' AS with_sign FROM ways")
def tag_parse(spark: SparkSession, d: str) -> DataFrame:
    w = dataset(spark, d).ways
    parsed = w.select("id", tags.parse_tags(F.concat(text.tags_text(F.col("tags")), F.lit("flag;note=a=b;;"))).alias("t"))
    return parsed.select("id", F.size("t").alias("n"), tags.get_tag(F.col("t"), "highway").alias("highway"), tags.get_tag(F.col("t"), "flag").alias("empty"), tags.get_tag(F.col("t"), "note").alias("with_sign"))


@query(ctes() + "SELECT way_id AS id, 'highway=' || highway || ';' || CASE WHEN building IS NOT NULL THEN 'building=no;' ELSE '' END || 'name=' || name || ';' || CASE WHEN building IS NULL THEN 'BUILDING=no;' ELSE '' END AS tags FROM ways")
def tag_add_or_replace(spark: SparkSession, d: str) -> DataFrame:
    w = dataset(spark, d).ways
    return w.select("id", text.tags_text(tags.add_or_replace_tag(F.col("tags"), "BUILDING", "no")).alias("tags"))


@query(
    ctes("t AS (SELECT 'highway' AS k, highway AS v FROM ways UNION ALL SELECT 'building', building FROM ways WHERE building IS NOT NULL UNION ALL SELECT 'name', name FROM ways)", "s AS (SELECT k AS string FROM t UNION ALL SELECT v FROM t UNION ALL SELECT k || '=' || v FROM t)")
    + "SELECT CAST(sum(length(string)) AS BIGINT) AS weight, string FROM s GROUP BY string HAVING sum(length(string)) > 1000"
)
def tag_weights(spark: SparkSession, d: str) -> DataFrame:
    return analyze.tag_weights(dataset(spark, d), 1000)


# ---- text ----

_SIX = "CASE WHEN {c} < 0 THEN '-' ELSE '' END || CAST((abs({c}) + 5) // 10 // 1000000 AS VARCHAR) || '.' || lpad(CAST((abs({c}) + 5) // 10 % 1000000 AS VARCHAR), 6, '0')"


@query(ctes() + f"SELECT 'N ' || node_id || ' ' || {_SIX.format(c='fixed_lat')} || ' ' || {_SIX.format(c='fixed_lon')} || ' ' AS line FROM nodes")
def text_lines_nodes(spark: SparkSession, d: str) -> DataFrame:
    return dataset(spark, d).nodes.select(text.node_line().alias("line"))


@query(ctes() + "SELECT 'W ' || way_id || ' highway=' || highway || ';' || coalesce('building=' || building || ';', '') || 'name=' || name || ';' AS line FROM ways")
def text_lines_ways(spark: SparkSession, d: str) -> DataFrame:
    return dataset(spark, d).ways.select(text.way_line().alias("line"))


@query(ctes() + "SELECT DISTINCT 'R ' || relation_id || ' ' AS line FROM members")
def text_lines_relations(spark: SparkSession, d: str) -> DataFrame:
    return dataset(spark, d).relations.select(text.relation_line().alias("line"))


@query(ctes("c AS (SELECT way_id, count(*) AS n FROM way_refs GROUP BY 1)") + "SELECT w.way_id AS id, 'Way with ' || (2 + CAST(building IS NOT NULL AS INT)) || ' tags and ' || n || ' nodes' AS said FROM ways w JOIN c ON c.way_id = w.way_id")
def way_texts(spark: SparkSession, d: str) -> DataFrame:
    return dataset(spark, d).ways.select("id", text.way_text().alias("said"))


# ---- extracts ----


@query(ctes() + "SELECT way_id AS id FROM ext_ways")
def extract_ways(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_ways(dataset(spark, d), BOX).select("id")


@query(ctes() + "SELECT node_id AS id, fixed_lat, fixed_lon FROM nodes WHERE node_id IN (SELECT node_id FROM way_refs WHERE way_id IN (SELECT way_id FROM ext_ways))")
def extract_nodes(spark: SparkSession, d: str) -> DataFrame:
    ds = dataset(spark, d)
    return extract.nodes_of(extract.extract_ways(ds, BOX), ds.nodes).select("id", "fixed_lat", "fixed_lon")


_EXTRACTED = """direct AS (SELECT relation_id FROM members WHERE mtype = 'WAY' AND member_id IN (SELECT way_id FROM ext_ways)
 UNION SELECT relation_id FROM members WHERE mtype = 'NODE' AND member_id IN (SELECT node_id FROM way_refs WHERE way_id IN (SELECT way_id FROM ext_ways)))"""
_CLOSED = "closed AS (SELECT relation_id FROM direct UNION SELECT m.relation_id FROM closed c JOIN members m ON m.mtype = 'RELATION' AND m.member_id = c.relation_id)"


@query(ctes(_EXTRACTED, _CLOSED, recursive=True) + "SELECT c.relation_id AS id, count(*) AS n_members FROM closed c JOIN members m ON m.relation_id = c.relation_id GROUP BY 1")
def extract_relations(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(dataset(spark, d), BOX).relations.select("id", F.size("members").cast("long").alias("n_members"))


@query(ctes("direct AS (SELECT DISTINCT relation_id FROM members WHERE mtype = 'WAY' AND member_id IN (SELECT way_id FROM ext_ways))", _CLOSED, recursive=True) + "SELECT relation_id FROM closed")
def relation_closure(spark: SparkSession, d: str) -> DataFrame:
    ds = dataset(spark, d)
    ways = extract.extract_ways(ds, BOX).select(F.col("id").alias("member_id"))
    return extract.parents(ds.relations, members(ds.relations).where("type = 'WAY'").join(ways, "member_id", "left_semi").select("relation_id"))


@query(ctes() + "SELECT CAST(row_number() OVER (ORDER BY xtile, ytile, way_id) AS BIGINT) AS place, way_id AS id FROM ext_ways JOIN tile_index USING (way_id)")
def entity_order(spark: SparkSession, d: str) -> DataFrame:
    ds = dataset(spark, d)
    placed = extract.extract_ways(ds, BOX).select("id").join(_index(ds).withColumnRenamed("way_id", "id"), "id")
    return places.numbered(placed, ["xtile", "ytile", "id"]).select(F.col("place").cast("long").alias("place"), "id")


@query(ctes() + "SELECT way_id AS id, xtile, ytile FROM tile_index JOIN ext_ways USING (way_id)")
def curve_extract(spark: SparkSession, d: str) -> DataFrame:
    """The ways of a box by a stored index along a space-filling curve."""
    path = folders.shared(spark, "curve")
    curve.write_index(_index(dataset(spark, d)), path)
    found = curve.read_index(spark, path, *tiles.tile_range(*BOX))
    return found.select(F.col("way_id").alias("id"), "xtile", "ytile")


_TILED = f"""tiled AS (SELECT z AS zoom, x >> (12 - z) AS xtile, y >> (12 - z) AS ytile, count(*) AS n
 FROM (SELECT {TILE['x'].format(lon='(fixed_lon / 1e7)')} AS x, {TILE['y'].format(lat='(fixed_lat / 1e7)')} AS y FROM nodes), range(13) t(z) GROUP BY 1, 2, 3)"""


@query(ctes(_TILED) + "SELECT CAST(t.zoom AS INT) AS zoom, CAST(t.xtile AS INT) AS xtile, CAST(t.ytile AS INT) AS ytile, t.n FROM tiled t LEFT JOIN tiled p ON p.zoom = t.zoom - 1 AND p.xtile = t.xtile // 2 AND p.ytile = t.ytile // 2 WHERE (t.n <= 500 OR t.zoom = 12) AND (t.zoom = 0 OR p.n > 500)")
def tile_pyramid(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of nodes, split where they hold over 500."""
    n = node_tile(spark, d)
    return curve.pyramid(n.select(curve.key(F.col("xtile"), F.col("ytile")).alias("key")), 12, 500)


# ---- changes ----

_LAST = "last_change AS (SELECT * FROM (SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, user_id * 100000 + 99999 AS node_id, CAST(450000000 + floor(value * 1000) AS INT) AS fixed_lat, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1)"


def node_changes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    empty = spark.createDataFrame([], changes.CHANGES)
    day = F.datediff("ts", F.lit("2024-01-01").cast("date")) + 1
    rows = e.select(
        day.cast("long").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1).alias("_ts"),
        F.col("event_id"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        F.lit("NODE").alias("type"),
        (F.col("user_id") * 100000 + 99999).alias("id"),
        (F.lit(450000000) + F.floor(F.col("value") * 1000)).cast("int").alias("fixed_lat"),
        F.lit(-1230000000).alias("fixed_lon"),
    )
    ordered = rows.withColumn("ord", F.row_number().over(Window.partitionBy("seq").orderBy("_ts", "event_id")).cast("long")).drop("_ts", "event_id")
    return empty.unionByName(ordered, allowMissingColumns=True)


@query(ctes(_LAST) + "SELECT node_id AS id, fixed_lat FROM nodes WHERE node_id NOT IN (SELECT node_id FROM last_change) UNION ALL SELECT node_id, fixed_lat FROM last_change WHERE op = 'upsert'")
def apply_changes_nodes(spark: SparkSession, d: str) -> DataFrame:
    return changes.apply_changes(dataset(spark, d), node_changes(spark, d)).nodes.select("id", "fixed_lat")


@query(ctes(_LAST) + "SELECT node_id AS id, op FROM last_change")
def last_changes(spark: SparkSession, d: str) -> DataFrame:
    return changes.last_changes(node_changes(spark, d)).select("id", "op")


def _changed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return spark.createDataFrame([], changes.CHANGES).unionByName(rows, allowMissingColumns=True)


@query(
    ctes("r AS (SELECT way_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY pos) AS refs, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY pos DESC) AS back FROM way_refs GROUP BY 1)")
    + "SELECT w.way_id AS id, CASE WHEN highway = 'urgent' THEN back ELSE refs END AS refs, CASE WHEN highway = 'urgent' THEN 'oneway=-1;' ELSE 'highway=' || highway || ';name=' || name || ';' END AS tags FROM ways w JOIN r ON r.way_id = w.way_id WHERE building IS NULL"
)
def apply_changes_ways(spark: SparkSession, d: str) -> DataFrame:
    """Buildings are deleted; urgent ways are turned round, with other tags."""
    ds = dataset(spark, d)
    urgent = tags.has_tag(F.col("tags"), "highway", "urgent")
    gone = tags.has_tag(F.col("tags"), "building")
    turned = F.array(tags.tag("oneway", F.lit("-1"))).cast(TAGS)
    rows = ds.ways.where(urgent | gone).select(F.lit(1).cast("long").alias("seq"), F.lit(0).cast("long").alias("ord"), F.when(gone, "delete").otherwise("upsert").alias("op"), F.lit("WAY").alias("type"), "id", F.reverse("nodes").alias("nodes"), turned.alias("tags"))
    after = changes.apply_changes(ds, _changed(spark, rows)).ways
    return after.select("id", F.concat_ws(",", F.col("nodes").cast("array<string>")).alias("refs"), text.tags_text(F.col("tags")).alias("tags"))


@query(
    ctes("kept AS (SELECT relation_id, string_agg(mtype || ' ' || member_id || CASE WHEN mrole <> '' THEN ' as ' || mrole ELSE '' END, ', ' ORDER BY mtype, member_id, mrole) AS said FROM members WHERE relation_id < 2000000000 GROUP BY 1)")
    + "SELECT relation_id AS id, said FROM kept UNION ALL SELECT DISTINCT relation_id, 'NODE 99999 as seat, RELATION ' || relation_id FROM members WHERE relation_id >= 2000000000 AND relation_id < 3000000000"
)
def apply_changes_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations of regions are deleted; those of nations get other members."""
    ds = dataset(spark, d)
    other = F.array(F.struct(F.lit("NODE").alias("type"), F.lit(99999).cast("long").alias("id"), F.lit("seat").alias("role")), F.struct(F.lit("RELATION").alias("type"), F.col("id").alias("id"), F.lit("").alias("role"))).cast(MEMBERS)
    rows = ds.relations.where("id >= 2000000000").select(F.lit(1).cast("long").alias("seq"), F.lit(0).cast("long").alias("ord"), F.when(F.col("id") >= 3000000000, "delete").otherwise("upsert").alias("op"), F.lit("RELATION").alias("type"), "id", other.alias("members"), "tags")
    after = changes.apply_changes(ds, _changed(spark, rows)).relations
    return after.select("id", F.concat_ws(", ", F.transform("members", text.member_text)).alias("said"))


@query("SELECT 'NODE' AS type, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, count(*) AS n FROM events GROUP BY 1, 2")
def applied_counts(spark: SparkSession, d: str) -> DataFrame:
    return changes.applied_counts(node_changes(spark, d))


@query(ctes() + "SELECT node_id AS id, node_id IN (SELECT r.node_id FROM way_refs r JOIN ways w ON w.way_id = r.way_id WHERE building IS NULL) AS inside, true AS every FROM nodes")
def bitmap_contains(spark: SparkSession, d: str) -> DataFrame:
    ds = dataset(spark, d)
    found = analyze.IdSet(analyze.referenced_nodes(ds.ways), "node_id").mark(ds.nodes.select("id"), "id", "inside")
    return analyze.EveryId().mark(found, "id", "every")


_MOVED = f"moved AS (SELECT w.way_id, {TILE['x'].format(lon='(n.fixed_lon / 1e7)')} AS xtile, {TILE['y'].format(lat='((n.fixed_lat + CASE WHEN n.node_id % 17 = 0 THEN 500000 ELSE 0 END) / 1e7)')} AS ytile FROM ways w JOIN way_refs r ON r.way_id = w.way_id AND r.pos = 0 JOIN nodes n ON n.node_id = r.node_id)"


@query(ctes(_MOVED) + "SELECT m.xtile, m.ytile, m.way_id FROM moved m JOIN tile_index t ON t.way_id = m.way_id WHERE m.xtile <> t.xtile OR m.ytile <> t.ytile")
def changed_way_reindex(spark: SparkSession, d: str) -> DataFrame:
    ds = dataset(spark, d)
    moved = ds.nodes.where("id % 17 = 0").select(F.lit(1).cast("long").alias("seq"), F.lit(0).cast("long").alias("ord"), F.lit("upsert").alias("op"), F.lit("NODE").alias("type"), "id", (F.col("fixed_lat") + 500000).alias("fixed_lat"), "fixed_lon", "tags")
    after = changes.apply_changes(ds, spark.createDataFrame([], changes.CHANGES).unionByName(moved, allowMissingColumns=True))
    return changes.reindexed(_index(ds), _index(after))


@query("SELECT seq, lpad(CAST(seq // 1000000 AS VARCHAR), 3, '0') || '/' || lpad(CAST(seq // 1000 % 1000 AS VARCHAR), 3, '0') || '/' || lpad(CAST(seq % 1000 AS VARCHAR), 3, '0') AS path FROM (SELECT DISTINCT l_orderkey * 1237 AS seq FROM lineitem)")
def sequence_path(spark: SparkSession, d: str) -> DataFrame:
    seq = table(spark, d, "lineitem").select((F.col("l_orderkey") * 1237).alias("seq")).distinct()
    return seq.select("seq", text.sequence_path(F.col("seq")).alias("path"))


@query("SELECT seq, min(t) AS timestamp FROM (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS BIGINT) AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) e GROUP BY 1 HAVING min(t) > 1704067200 + 10 * 86400")
def pending_diffs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    iso = F.concat(F.replace(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(":"), F.lit("\\:")), F.lit("Z"))
    diffs = e.select((F.datediff("ts", F.lit("2024-01-01").cast("date")) + 1).cast("long").alias("seq"), text.state_epoch(iso).alias("t")).groupBy("seq").agg(F.min("t").alias("timestamp"))
    return changes.pending(diffs, 1704067200 + 10 * 86400)


# ---- enrichment and codes ----


@query(ctes("s AS (SELECT l_orderkey AS way_id, max(l_quantity) AS speed FROM lineitem GROUP BY 1)") + "SELECT w.way_id AS id, CASE WHEN s.speed IS NOT NULL THEN CAST(CAST(s.speed AS INT) AS VARCHAR) || '.0 kph' END AS speed FROM ways w LEFT JOIN s ON s.way_id = w.way_id")
def speed_update(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    # The last row of an id wins, so the largest comes last.
    speeds = lines.select(F.col("l_orderkey").alias("way_id"), F.col("l_quantity").alias("speed"), F.col("l_quantity").alias("line")).unionByName(spark.createDataFrame([(-5, 30.0, 1.0)], "way_id bigint, speed double, line double"))
    return enrich.set_speeds(dataset(spark, d).ways, speeds).select("id", tags.get_tag(F.col("tags"), "maxspeed:motorcar").alias("speed"))


@query(ctes() + "SELECT way_id, pos, node_id - coalesce(lag(node_id) OVER (PARTITION BY way_id ORDER BY pos), 0) AS delta, node_id FROM way_refs")
def delta_encode(spark: SparkSession, d: str) -> DataFrame:
    coded = coding.delta_encode(way_refs(dataset(spark, d).ways), "node_id", block=["way_id"], order=["pos"], out="delta")
    back = coding.delta_decode(coded.drop("node_id"), "delta", block=["way_id"], order=["pos"], out="node_id")
    return back.select("way_id", "pos", "delta", "node_id")


@query(ctes() + "SELECT way_id, pos, CASE WHEN n >= 0 THEN 2 * n ELSE -2 * n - 1 END AS code, n FROM (SELECT way_id, pos, CASE WHEN pos % 2 = 0 THEN node_id * 1000 ELSE -node_id * 1000 END AS n FROM way_refs)")
def zigzag(spark: SparkSession, d: str) -> DataFrame:
    n = way_refs(dataset(spark, d).ways).select("way_id", "pos", F.when(F.col("pos") % 2 == 0, F.col("node_id") * 1000).otherwise(-F.col("node_id") * 1000).alias("n"))
    coded = n.select("way_id", "pos", coding.zigzag(F.col("n")).alias("code"))
    return coded.withColumn("n", coding.unzigzag(F.col("code")))


@query(
    ctes("t AS (SELECT way_id // 8000 AS block, way_id * 10 + p AS place, s FROM ways, LATERAL (VALUES (0, 'highway'), (1, highway), (2, 'name'), (3, name)) v(p, s))", "f AS (SELECT block, s, min(place) AS first FROM t GROUP BY 1, 2)")
    + "SELECT block, s, CAST(row_number() OVER (PARTITION BY block ORDER BY first, s) AS INT) AS code FROM f"
)
def string_codes(spark: SparkSession, d: str) -> DataFrame:
    w = dataset(spark, d).ways
    own = F.filter("tags", lambda t: t["key"] != "building")
    strings = w.select(F.floor(F.col("id") / 8000).alias("block"), "id", F.posexplode(F.flatten(F.transform(own, lambda t: F.array(t["key"], t["value"])))).alias("p", "s"))
    return coding.string_codes(strings.withColumn("place", F.col("id") * 10 + F.col("p")), block=["block"], text="s", order="place")


# ---- formats ----


def _round_trip(spark: SparkSession, d: str, fmt: str) -> DataFrame:
    """All entities, through the format's writers, a folder of parts, and back."""
    path = folders.shared(spark, fmt).removeprefix("file://").removeprefix("file:")
    files.save_parts(dataset(spark, d), path, fmt, pieces(spark, d))
    back = files.load_osm(spark, path)
    n = back.nodes.select(F.lit("NODE").alias("kind"), "id", F.concat_ws(" ", "fixed_lat", "fixed_lon", text.tags_text(F.col("tags"))).alias("said"))
    w = back.ways.select(F.lit("WAY").alias("kind"), "id", F.concat_ws(" ", F.concat_ws(",", F.col("nodes").cast("array<string>")), text.tags_text(F.col("tags"))).alias("said"))
    r = back.relations.select(F.lit("RELATION").alias("kind"), "id", F.concat_ws(", ", F.transform("members", text.member_text)).alias("said"))
    return n.unionByName(w).unionByName(r)


_BACK = (
    ctes("refs AS (SELECT way_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY pos) AS said FROM way_refs GROUP BY 1)")
    + """SELECT 'NODE' AS kind, node_id AS id, fixed_lat || ' ' || fixed_lon || ' ' AS said FROM nodes
 UNION ALL SELECT 'WAY', w.way_id, r.said || ' highway=' || highway || ';' || coalesce('building=' || building || ';', '') || 'name=' || name || ';' FROM ways w JOIN refs r ON r.way_id = w.way_id
 UNION ALL SELECT 'RELATION', relation_id, string_agg(mtype || ' ' || member_id || CASE WHEN mrole <> '' THEN ' as ' || mrole ELSE '' END, ', ' ORDER BY mtype, member_id, mrole) FROM members GROUP BY 2"""
)


@query(_BACK)
def pbf_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "pbf")


@query(_BACK)
def vex_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "vex")


from . import kept_current, values  # noqa: E402,F401  register their queries

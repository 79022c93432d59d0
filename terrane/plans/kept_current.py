"""Registered queries of what is kept current: replication, keyed state, the log-structured store, derived sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import has_tag
from ..model import RELATIONS, WAYS, OsmDataset
from ..operators import changes, derived, segments
from ..sources import folders
from ..streaming import latest, replication
from . import fixtures
from .catalogue import _LAST, _changed, node_changes, query
from .fixtures import ctes, dataset

_AFTER = "SELECT node_id AS id, fixed_lat FROM nodes WHERE node_id NOT IN (SELECT node_id FROM last_change) UNION ALL SELECT node_id, fixed_lat FROM last_change WHERE op = 'upsert'"


def _server(spark: SparkSession, d: str) -> tuple[str, list[int]]:
    """A folder with the diffs of node_changes, without states; and their sequence numbers, a gap-free range."""
    base = folders.shared(spark, "server").removeprefix("file://").removeprefix("file:")
    rows = node_changes(spark, d)
    first, last = rows.agg(F.min("seq"), F.max("seq")).first()
    days = spark.range(first, last + 1).select(F.col("id").alias("seq"))
    fixtures.publish(rows.join(days, "seq", "right").withColumn("type", F.lit("NODE")).where("id is not null"), base)
    return base, list(range(first, last + 1))


@query(
    "WITH c AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS BIGINT) AS seq, event_type FROM events) "
    "SELECT seq AS sequence, 1704067200 + 86400 * seq AS timestamp, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_deletes, CAST(1 AS BIGINT) AS n_read FROM c GROUP BY 1"
)
def replication_sequences(spark: SparkSession, d: str) -> DataFrame:
    """All diffs through the streaming source, in two runs of one query: the second goes on where the first one stopped."""
    base, sequences = _server(spark, d)
    out, checkpoint = folders.shared(spark, "read"), folders.shared(spark, "offsets")
    half = len(sequences) // 2
    before = fixtures.day(sequences[0] - 1)
    fixtures.publish_states(base, [sequences[0] - 1])
    for part in (sequences[:half], sequences[half:]):
        fixtures.publish_states(base, part)
        rows = replication.read_replication(spark, base, before, "minute")
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.schema(replication.ROWS).parquet(out)
    count = lambda c: F.count(F.when(c, 1))
    return got.groupBy("sequence", "timestamp").agg(count(F.col("op") != "state").alias("n"), count(F.col("op") == "delete").alias("n_deletes"), count(F.col("op") == "state").alias("n_read"))


@query(ctes(_LAST) + _AFTER)
def replicated_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A log-structured store that follows a server, diff after diff, and is compacted meanwhile."""
    base, sequences = _server(spark, d)
    path = folders.shared(spark, "store")
    nodes = dataset(spark, d).nodes
    segments.create(OsmDataset.of(nodes, spark.createDataFrame([], WAYS), spark.createDataFrame([], RELATIONS), fixtures.day(sequences[0] - 1)), path, ranges=16)
    fixtures.publish_states(base, [sequences[0] - 1, *sequences])
    replication.follow(spark, path, base, folders.shared(spark, "offsets"), once=True, timescales="minute").awaitTermination()
    return segments.load(spark, path).nodes.select("id", "fixed_lat")


@query(ctes(_LAST) + _AFTER)
def keyed_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes that arrive out of order, as keyed state; what it holds at the end is applied."""
    came, checkpoint = folders.shared(spark, "changes"), folders.shared(spark, "state")
    files = max(2, -(-folders.size(spark, f"{d}/events.parquet") // (3 * fixtures.PIECE)))  # of each of three batches
    node_changes(spark, d).repartition(3 * files, F.xxhash64("id", "ord")).write.parquet(came)
    rows = spark.readStream.schema(changes.CHANGES).option("maxFilesPerTrigger", files).parquet(came)
    start = latest.last_change_stream(rows).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start
    latest.with_rocksdb(spark, start).awaitTermination()
    return changes.upsert(dataset(spark, d).nodes.select("id", "fixed_lat"), latest.read_state(spark, checkpoint).where("type = 'NODE'"))


@query(ctes(_LAST) + _AFTER)
def segmented_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Changes in five segments, merged when read; every other one is compacted."""
    path, rows = folders.shared(spark, "store"), node_changes(spark, d)
    ds = dataset(spark, d)
    segments.create(OsmDataset.of(ds.nodes, spark.createDataFrame([], WAYS), spark.createDataFrame([], RELATIONS)), path, ranges=16)
    first, last = rows.agg(F.min("seq"), F.max("seq")).first()
    for k in range(5):
        cut = F.floor((F.col("seq") - first) * 5 / (last - first + 1)) == k
        segments.append(spark, path, rows.where(cut), fixtures.day(k), k + 1)
        if k % 2:
            segments.compact(spark, path)
    return segments.load(spark, path).nodes.select("id", "fixed_lat")


_DERIVED = """new_ways AS (SELECT way_id, highway = 'urgent' AS turned, building IS NOT NULL AS gone FROM ways),
r AS (SELECT r.node_id FROM way_refs r JOIN new_ways w ON w.way_id = r.way_id WHERE NOT gone AND (NOT turned OR pos > 0)),
n AS (SELECT node_id FROM nodes WHERE node_id % 7 <> 0 AND node_id % 100000 <> 99999 UNION ALL SELECT DISTINCT node_id + 1 FROM nodes WHERE node_id % 7 = 0 AND node_id % 100000 = 99999)"""


@query(
    ctes(_DERIVED)
    + """SELECT node_id AS id, CAST(sum(refs) AS BIGINT) AS refs, sum(refs) > 1 AS intersection, sum(refs) > 0 AND sum(here) = 0 AS dangling
 FROM (SELECT node_id, 1 AS refs, 0 AS here FROM r UNION ALL SELECT node_id, 0, 1 FROM n) GROUP BY 1"""
)
def derived_sets(spark: SparkSession, d: str) -> DataFrame:
    """Buildings go, urgent ways lose their first node, nodes of every seventh id go, some come: counts kept by differences from the stored ones."""
    ds = dataset(spark, d)
    path = folders.shared(spark, "store")
    segments.create(OsmDataset.of(ds.nodes, ds.ways, spark.createDataFrame([], RELATIONS)), path, ranges=16, indexes=("counts",), parts=fixtures.pieces(spark, d))
    ds = segments.load(spark, path, 1)  # the same rows: the changes below need not make them again
    put, one = lambda c: F.lit(c), F.lit(1).cast("long")
    keyed = lambda df, type_, op: df.select(one.alias("seq"), F.lit(0).cast("long").alias("ord"), op.alias("op"), F.lit(type_).alias("type"), "*")
    building = has_tag(F.col("tags"), "building")
    ways = ds.ways.where(building | has_tag(F.col("tags"), "highway", "urgent")).select("id", F.slice("nodes", 2, 100_000).alias("nodes"), "tags")
    ways = keyed(ways, "WAY", F.when(building, "delete").otherwise("upsert"))
    point = F.col("id") % 100_000 == 99_999
    nodes = keyed(ds.nodes.where((F.col("id") % 7 == 0) | point).select("id"), "NODE", put("delete"))
    more = keyed(ds.nodes.where((F.col("id") % 7 == 0) & point).withColumn("id", F.col("id") + 1), "NODE", put("upsert"))
    for k, rows in enumerate((ways, nodes, more)):
        segments.append(spark, path, _changed(spark, rows), sequence=k + 1)
    found = segments.load_counts(spark, path)
    return found.select("id", "refs", derived.intersection().alias("intersection"), derived.dangling().alias("dangling"))

"""Changes as keyed state: the last change of each entity, in whatever order diffs arrive.

The state of a (type, id) is its last change by (seq, ord), a delete too: a tombstone, so that an older upsert that comes late does not bring
the entity back. A batch touches the state of the ids that it names and no other. The state is that of a streaming aggregate: changes of a batch
are brought down to one for each id before they are shuffled, and none goes through Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.changes import CHANGES

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What an upsert brings.
FIELDS = ("fixed_lat", "fixed_lon", "nodes", "members", "tags")


def last_change_stream(changes: DataFrame) -> DataFrame:
    """changes: a stream of CHANGES. Rows type, id, seq, ord, op, payload (JSON) whenever an entity's last change is a newer one. In update mode."""
    before = -F.unix_millis(F.current_timestamp())  # one value in a batch; of a change that is sent again, the first one stays
    kept = changes.where("id is not null and id >= 0").withColumn("_before", before).withColumn("_p", F.when(F.col("op") == "upsert", F.struct(*FIELDS)))
    last = kept.groupBy("type", "id").agg(F.max(F.struct("seq", "ord", "_before", "op", "_p")).alias("last")).where(F.col("last._before") == before)
    return last.select("type", "id", "last.seq", "last.ord", "last.op", F.to_json("last._p").alias("payload"))


def payload_schema(spark: SparkSession) -> StructType:
    return StructType([f for f in spark.createDataFrame([], CHANGES).schema if f.name in FIELDS])


def unpacked(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The columns of CHANGES of rows with a payload."""
    told = rows.withColumn("_p", F.from_json("payload", payload_schema(spark)))
    return told.select("seq", "ord", "op", "type", "id", *(F.col(f"_p.{c}").alias(c) for c in FIELDS))


def with_rocksdb(spark: SparkSession, start):
    """start() with the state store that keeps keyed state off the heap; the session is as before afterwards, and the query keeps it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a query's state holds, as CHANGES: one row for each entity that was ever changed."""
    state = spark.read.format("statestore").load(checkpoint).select("key.*", "value.*").toDF("type", "id", "last")
    return state.select("last.seq", "last.ord", "last.op", "type", "id", *(F.col(f"last._p.{c}").alias(c) for c in FIELDS))

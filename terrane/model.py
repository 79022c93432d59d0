"""The data model: three entity tables and one row of metadata, with the views that other operators use."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS = "array<struct<key:string,value:string>>"
MEMBERS = "array<struct<type:string,id:bigint,role:string>>"
NODES = f"id bigint, fixed_lat int, fixed_lon int, tags {TAGS}"
WAYS = f"id bigint, nodes array<bigint>, tags {TAGS}"
RELATIONS = f"id bigint, members {MEMBERS}, tags {TAGS}"
META = "replication_timestamp bigint, sequence_number bigint"
TYPES = ("NODE", "WAY", "RELATION")  # fixed order: the codes 0, 1, 2 of the binary formats


@dataclass
class OsmDataset:
    """nodes, ways, relations and meta as lazy DataFrames; ids are columns, tags ordered arrays that may repeat keys."""

    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame
    meta: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @staticmethod
    def empty(spark: SparkSession) -> OsmDataset:
        return OsmDataset(*(spark.createDataFrame([], s) for s in (NODES, WAYS, RELATIONS)), spark.createDataFrame([(0, 0)], META))

    @staticmethod
    def of(nodes: DataFrame, ways: DataFrame, relations: DataFrame, timestamp: int = 0, sequence: int = 0) -> OsmDataset:
        return OsmDataset(nodes, ways, relations, nodes.sparkSession.createDataFrame([(timestamp, sequence)], META))

    def way_refs(self) -> DataFrame:
        return way_refs(self.ways)

    def members(self) -> DataFrame:
        return members(self.relations)

    def counts(self) -> DataFrame:
        """Entities by type (one row)."""
        one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
        return one(self.nodes, "nodes").crossJoin(one(self.ways, "ways")).crossJoin(one(self.relations, "relations"))  # three single rows

    def timestamp(self) -> int:
        row = self.meta.first()
        return row["replication_timestamp"] if row else 0


def way_refs(ways: DataFrame) -> DataFrame:
    return ways.select(F.col("id").alias("way_id"), F.posexplode("nodes").alias("pos", "node_id"))


def members(relations: DataFrame) -> DataFrame:
    return relations.select(F.col("id").alias("relation_id"), F.posexplode("members").alias("pos", "m")).select("relation_id", "pos", F.col("m.type").alias("type"), F.col("m.id").alias("member_id"), F.col("m.role").alias("role"))

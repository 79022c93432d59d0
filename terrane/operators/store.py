"""A store: versioned Parquet tables in one folder. Metadata is written last, so a version without it does not count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import META, NODES, RELATIONS, WAYS, OsmDataset
from ..sources import folders
from . import segments
from .index import tile_index

TABLES = {"nodes": NODES, "ways": WAYS, "relations": RELATIONS}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    found = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()]
    return sorted(v for v in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}/meta/_SUCCESS")))


def _write(ds: OsmDataset, at: str) -> None:
    for name in TABLES:
        df = getattr(ds, name)
        # Ranges of ids, sorted, so that a look-up by id reads few row groups.
        df.repartitionByRange(_parts(df), "id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{at}/{name}")
    spark = ds.spark
    index = tile_index(spark.read.parquet(f"{at}/ways"), spark.read.parquet(f"{at}/nodes"))
    index.repartitionByRange(_parts(index), "xtile", "ytile").sortWithinPartitions("xtile", "ytile", "way_id").write.mode("overwrite").partitionBy("xtile").parquet(f"{at}/tile_index")
    ds.meta.coalesce(1).write.mode("overwrite").parquet(f"{at}/meta")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def save(ds: OsmDataset, path: str) -> None:
    """A new store. One that holds data already is refused."""
    if versions(ds.spark, path):
        raise FileExistsError(f"{path} holds a dataset already")
    _write(ds, f"{path}/v1")


def save_next(ds: OsmDataset, path: str) -> int:
    """A further version of a store."""
    v = max(versions(ds.spark, path), default=0) + 1
    _write(ds, f"{path}/v{v}")
    return v


def load(spark: SparkSession, path: str, version: int | None = None) -> OsmDataset:
    if folders.exists(spark, f"{path}/log"):  # a log-structured store
        return segments.load(spark, path, version)
    v = version or max(versions(spark, path), default=0)
    if not v:
        raise FileNotFoundError(f"{path} holds no dataset")
    return OsmDataset(*(spark.read.schema(s).parquet(f"{path}/v{v}/{n}") for n, s in TABLES.items()), spark.read.schema(META).parquet(f"{path}/v{v}/meta"))


def load_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The tile index, laid out by xtile: a filter on tiles reads only their folders."""
    if folders.exists(spark, f"{path}/log"):
        return segments.load_index(spark, path, version)
    v = version or max(versions(spark, path), default=0)
    return spark.read.schema("ytile int, way_id long, xtile int").parquet(f"{path}/v{v}/tile_index").select("xtile", "ytile", "way_id")


def load_or_fill(spark: SparkSession, path: str, source: str) -> OsmDataset:
    """The store, filled from a file first if it is empty."""
    if not versions(spark, path):
        from ..sources.files import load_osm

        save(load_osm(spark, source), path)
    return load(spark, path)


def prune(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the latest versions."""
    for v in versions(spark, path)[:-keep]:
        fs, p = _fs(spark, f"{path}/v{v}")
        fs.delete(p, True)


def by_id(df: DataFrame, *ids: int) -> DataFrame:
    return df.where(F.col("id").isin(list(ids)))

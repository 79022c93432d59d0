"""Tables written to the shared folder, to cut lineage in a way that survives lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_left: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset, on a single machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="terrane-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again. The files go at the end of the application, or with drop().

    Once the table is written, nothing needs the shuffle files behind it, so Spark is told to delete them then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _left[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path  # type: ignore[attr-defined]
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the files of stashed tables that nothing will read again."""
    for df in frames:
        path = getattr(df, "_stashed", None)
        if path:
            _delete(path)


def _delete(path: str) -> None:
    spark = _left.pop(path, None)
    if spark is not None:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _at_exit() -> None:
    for path in list(_left):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column cast to a type, or nulls where the table lacks it."""
    return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() is quicker and the same where a text is pure ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


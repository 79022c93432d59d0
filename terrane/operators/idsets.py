"""Compressed sets of ids with algebra. A set is a table with a row for each bucket of 2 ** 16 ids that has any: bucket, n, form and data.

form says how the low 16 bits of the ids are held, whichever takes the fewest bytes: "array" (2 bytes an id), "run" (4 bytes a run of
consecutive ids) or "bitmap" (8 KB). Operations meet bucket by bucket, so that a shuffle moves containers and not ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

SET = "bucket bigint, n int, form string, data binary"
_SET = pa.schema([("bucket", pa.int64()), ("n", pa.int32()), ("form", pa.string()), ("data", pa.binary())])
BITMAP = 1 << 13  # bytes
GROUP, LEVELS = 10, 5  # buckets of a rank's group, as a power of two; 5 times 10 bits are more than the 48 of a bucket


def pack(low: np.ndarray) -> tuple[str, bytes]:
    """Sorted distinct numbers under 2 ** 16, in the form that is smallest."""
    borders = np.flatnonzero(np.diff(low.astype(np.int32), prepend=-2) != 1)
    if 4 * len(borders) < min(2 * len(low), BITMAP):
        ends = np.r_[borders[1:], len(low)]
        return "run", np.stack([low[borders], ends - borders - 1], 1).astype("<u2").tobytes()
    if 2 * len(low) <= BITMAP:
        return "array", low.astype("<u2").tobytes()
    bits = np.zeros(1 << 16, np.uint8)
    bits[low] = 1
    return "bitmap", np.packbits(bits, bitorder="little").tobytes()


def unpack(form: str | None, data: bytes | None) -> np.ndarray:
    if form is None:
        return np.zeros(0, np.int64)
    if form == "array":
        return np.frombuffer(data, "<u2").astype(np.int64)
    if form == "bitmap":
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))
    runs = np.frombuffer(data, "<u2").astype(np.int64).reshape(-1, 2)
    lengths = runs[:, 1] + 1
    return np.repeat(runs[:, 0] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())


def _rows(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    kept = [(b, len(low), *pack(low)) for b, low in found if len(low)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept) if kept else [[]] * 4, _SET)], schema=_SET)


def _bucket(id_: Column) -> Column:
    return F.shiftright(id_, 16)


def build(ids: DataFrame, column: str) -> DataFrame:
    """The set of ids in a column; nulls are in no set."""
    own = ids.select(F.col(f"`{column}`").cast("long").alias("id")).where("id is not null").distinct()  # of an id, one row in each task is shuffled
    grouped = own.groupBy(_bucket(F.col("id")).alias("bucket")).agg(F.collect_list(F.col("id").bitwiseAND(F.lit(0xFFFF)).cast("int")).alias("low"))

    def pack_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows([(k.as_py(), np.unique(v.values.to_numpy())) for k, v in zip(b.column(0), b.column(1))])

    return grouped.mapInArrow(pack_all, SET)


def ids_of(held: DataFrame) -> DataFrame:
    """The ids of a set, one a row."""

    def unpack_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array((r["bucket"] << 16) + unpack(r["form"], r["data"]), pa.int64())], names=["id"])

    return held.select("bucket", "form", "data").mapInArrow(unpack_all, "id long")


def _combine(a: DataFrame, b: DataFrame, how: str, operation: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    met = a.select("bucket", F.col("form").alias("f1"), F.col("data").alias("d1")).join(b.select("bucket", F.col("form").alias("f2"), F.col("data").alias("d2")), "bucket", how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows([(r["bucket"], operation(unpack(r["f1"], r["d1"]), unpack(r["f2"], r["d2"]))) for r in batch.to_pylist()])

    return met.mapInArrow(run, SET)


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combine(a, b, "full", np.union1d)


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combine(a, b, "inner", lambda x, y: np.intersect1d(x, y, assume_unique=True))


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combine(a, b, "left", lambda x, y: np.setdiff1d(x, y, assume_unique=True))


def cardinality(held: DataFrame) -> DataFrame:
    return held.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def ranks(held: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Of each distinct id in a column: whether it is in the set, and its rank, the number of ids of the set that are not greater."""
    asked = ids.select(F.col(f"`{column}`").cast("long").alias("id")).where("id is not null").distinct().withColumn("bucket", _bucket(F.col("id")))
    held = cut(held)
    # Buckets that are asked for stand in the order too, empty or not. Each level reads them.
    places = cut(held.select("bucket", "n").unionByName(asked.select("bucket", F.lit(0).alias("n"))).groupBy("bucket").agg(F.sum("n").alias("n")))
    # What stands before a bucket, in its group of 2 ** GROUP; before that group in its own group; and so on. No task sorts more than that many rows.
    offsets = places.select("bucket", F.lit(0).cast("long").alias("start"))
    level = places.select((F.col("bucket") + (1 << 47)).alias("p"), "n")
    for k in range(LEVELS):
        own = Window.partitionBy(F.shiftright("p", GROUP)).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        before = level.select("p", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("before"))
        offsets = offsets.withColumn("p", F.shiftright(F.col("bucket") + (1 << 47), GROUP * k)).join(before, "p").select("bucket", (F.col("start") + F.col("before")).alias("start"))
        level = level.groupBy(F.shiftright("p", GROUP).alias("p")).agg(F.sum("n").alias("n"))
    lists = asked.groupBy("bucket").agg(F.collect_list("id").alias("ids")).join(offsets, "bucket").join(held.select("bucket", "form", "data"), "bucket", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                low, own = unpack(r["form"], r["data"]), np.array(r["ids"], np.int64)
                at = np.searchsorted(low, own & 0xFFFF, "right")
                inside = np.isin(own & 0xFFFF, low)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(inside), pa.array(at + r["start"], pa.int64())], names=["id", "inside", "rank"])

    return lists.mapInArrow(run, "id long, inside boolean, rank long")


def bytes_of(held: DataFrame) -> DataFrame:
    return held.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).cast("long").alias("bytes"))

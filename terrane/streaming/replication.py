"""Replication as a streaming source: the offset is the last sequence number that was read, with its timestamp.

Spark asks the source for the latest state, writes the offset to the query's checkpoint, and lets one task fetch and parse each diff between two offsets.
A batch that runs again reads the same diffs, so a query that was killed goes on where it stood. What lies between two offsets is read in
the coarsest diffs that fit: days while the end is more than a day ahead, then hours, then the finest. A sequence number that is missing is an error.

Options of the format "osmreplication": base (a folder that all executors see, or a URL), timestamp (of the store: only newer diffs are read),
timescales (default day,hour,minute), and most, diffs a batch at the finest scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.text import Timescale
from ..operators import segments
from ..operators.changes import CHANGES
from ..sources import folders
from ..sources.osmchange import _schema as CHANGE_SCHEMA
from ..sources.osmchange import parse
from .updater import Diff, check_timestamp, fetch_from, path_of, state

#: A change, with the diff that it is of. seq orders diffs of all timescales. Each diff also gives one row of op 'state', without an entity.
ROWS = f"{CHANGES}, timescale string, sequence bigint, timestamp bigint"
_ROWS = pa.schema([*CHANGE_SCHEMA, ("timescale", pa.string()), ("sequence", pa.int64()), ("timestamp", pa.int64())])
CHUNK = 10_000


class DiffPartition(InputPartition):
    def __init__(self, diff: Diff):
        self.diff = diff


class ReplicationReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.base = options["base"]
        self.since = int(options.get("timestamp", 0))
        check_timestamp(self.since)
        self.scales = [Timescale[s.strip().upper()] for s in options.get("timescales", "day,hour,minute").split(",")]

    def _latest(self) -> Diff | None:
        return state(fetch_from(self.base), self.scales[-1])

    def initialOffset(self) -> dict:
        return {"sequence": -1, "timestamp": self.since}

    def latestOffset(self) -> dict:
        now = self._latest()
        return self.initialOffset() if now is None or now.timestamp <= self.since else {"sequence": now.sequence, "timestamp": now.timestamp}

    def partitions(self, start: dict, end: dict) -> list[DiffPartition]:
        return [DiffPartition(d) for d in plan(self.base, self.scales, start, end)]

    def read(self, partition: DiffPartition) -> Iterator[pa.RecordBatch]:
        d = partition.diff
        path = f"{d.timescale.lower()}/{path_of(d.sequence)}.osc.gz"
        raw = fetch_from(self.base)(path)
        if raw is None:
            raise LookupError(f"diff {path} is missing")
        own = {"timescale": d.timescale.lower(), "sequence": d.sequence, "timestamp": d.timestamp}
        rows = [{"seq": d.timestamp, "ord": -1, "op": "state", **own}]
        for change in parse(raw, d.timestamp):
            rows.append(change | own)
            if len(rows) == CHUNK:
                yield pa.RecordBatch.from_pylist(rows, _ROWS)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, _ROWS)


def plan(base: str, scales: list[Timescale], start: dict, end: dict) -> list[Diff]:
    """The diffs that lead from one offset to another, oldest first."""
    fetch, at, out = fetch_from(base), start["timestamp"], []
    for scale in scales[:-1]:
        if end["timestamp"] - at > scale.value:
            out += (found := _between(fetch, scale, at, state(fetch, scale), end["timestamp"]))
            at = found[-1].timestamp if found else at
    if at < end["timestamp"]:
        out += _between(fetch, scales[-1], at, state(fetch, scales[-1], end["sequence"]), end["timestamp"], start["sequence"])
    return out


def _between(fetch, scale: Timescale, after: int, now: Diff | None, until: int, passed: int = -1) -> list[Diff]:
    """Diffs of one timescale with after < timestamp <= until, walking back from a state."""
    if now is None and passed < 0 and state(fetch, scale) is None:
        return []  # the server has none of this timescale
    out: list[Diff] = []
    while now is not None and now.timestamp > after and now.sequence > passed:
        if now.timestamp <= until:
            out.append(now)
        if now.sequence == 0:
            return out[::-1]
        last, now = now, state(fetch, scale, now.sequence - 1)
        if now is None:
            raise LookupError(f"state {last.sequence - 1} of {scale.lower()} is missing")
    if now is None:
        raise LookupError(f"a state of {scale.lower()} is missing")
    return out[::-1]


class ReplicationSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osmreplication"

    def schema(self) -> str:
        return ROWS

    def streamReader(self, schema) -> ReplicationReader:
        return ReplicationReader(self.options)


def read_replication(spark: SparkSession, base: str, timestamp: int, timescales: str = "day,hour,minute") -> DataFrame:
    """The changes of all diffs newer than a timestamp, as a streaming DataFrame."""
    spark.dataSource.register(ReplicationSource)
    return spark.readStream.format("osmreplication").option("base", base).option("timestamp", timestamp).option("timescales", timescales).load()


def apply_batch(spark: SparkSession, path: str, batch: DataFrame) -> list[int]:
    """Apply the diffs of a batch to a log-structured store, one after another; each moves the store's time, so that what was applied stays if a later one fails.

    The store's timestamp tells which diffs of a batch that runs again are in already.
    """
    at = folders.shared(spark, "diffs")
    batch.write.partitionBy("timestamp").parquet(at)  # every diff is fetched once
    rows = spark.read.schema(ROWS).parquet(at)
    done = []
    try:
        for d in rows.where("op = 'state'").select("timestamp", "sequence").distinct().orderBy("timestamp").collect():  # one row a diff
            v = segments.current(spark, path)
            if d["timestamp"] > v.timestamp:
                own = rows.where((F.col("timestamp") == d["timestamp"]) & F.col("id").isNotNull())
                # Sequence numbers of several timescales don't compare; the timestamps do.
                segments.append(spark, path, own.drop("timescale", "sequence", "timestamp"), d["timestamp"])
                done.append(d["timestamp"])
    finally:
        folders.delete(spark, at)
    return done


def follow(spark: SparkSession, path: str, base: str, checkpoint: str, *, once: bool = False, every: str = "60 seconds", timescales: str = "day,hour,minute", compact: float | None = 0.1):
    """Keep a log-structured store current from a replication server: a streaming query. once: until the server has no more."""

    def apply(batch: DataFrame, _: int) -> None:
        if apply_batch(spark, path, batch) and compact is not None:
            segments.compact(spark, path, compact)

    changes = read_replication(spark, base, segments.current(spark, path).timestamp, timescales)
    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()

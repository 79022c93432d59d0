"""Keeping a store current from replication diffs: by polling a replication server, or as a stream of files."""

from __future__ import annotations

import gzip
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Timescale
from ..operators import store
from ..operators.changes import CHANGES, apply_changes
from ..sources import folders, opened
from ..sources.osmchange import changes_of, parse, parse_state, sequence_of

EARLIEST, LATEST = 1430438400, 4105123200  # 2015-05-01 and 2100-02-01: a store's timestamp outside is not believed
Fetch = Callable[[str], "bytes | None"]


@dataclass(frozen=True)
class Diff:
    timescale: Timescale
    sequence: int
    timestamp: int


def path_of(sequence: int) -> str:
    return f"{sequence // 1_000_000:03d}/{sequence // 1000 % 1000:03d}/{sequence % 1000:03d}"


def fetch_from(base: str) -> Fetch:
    """Reads below a folder or a URL; None where there is nothing."""

    def fetch(path: str) -> bytes | None:
        at = f"{base.rstrip('/')}/{path}"
        try:
            if "://" in base:
                with urllib.request.urlopen(at) as f:  # noqa: S310
                    return f.read()
            with open(at, "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            raise  # a server's fault is not an empty folder

    return fetch


def state(fetch: Fetch, timescale: Timescale, sequence: int | None = None) -> Diff | None:
    """The latest state of a timescale, or that of one sequence number."""
    raw = fetch(f"{timescale.lower()}/" + ("state.txt" if sequence is None else path_of(sequence) + ".state.txt"))
    if raw is None:
        return None
    when, seq = parse_state(raw.decode())
    return Diff(timescale, seq, when)


def find_diffs(fetch: Fetch, timescale: Timescale, after: int) -> list[Diff]:
    """Diffs strictly newer than a timestamp, oldest first. A missing one is an error: what it held would be lost."""
    out, now = [], state(fetch, timescale)
    if now is None:
        return []
    while now.timestamp > after:
        out.append(now)
        if now.sequence == 0:
            break
        before = state(fetch, timescale, now.sequence - 1)
        if before is None:
            raise LookupError(f"state {now.sequence - 1} of {timescale.lower()} is missing")
        now = before
    return out[::-1]


def check_timestamp(when: int) -> None:
    if not EARLIEST <= when <= LATEST:
        raise ValueError(f"the store's timestamp {when} is not plausible")


def plausible(when: Column) -> Column:
    """The same for a column of timestamps."""
    return F.coalesce(when.between(EARLIEST, LATEST), F.lit(False))


def advance(spark: SparkSession, path: str, changes: DataFrame, timestamp: int | None, sequence: int | None) -> None:
    """A next version of the store with the changes; its metadata is written last."""
    store.save_next(apply_changes(store.load(spark, path), changes, timestamp, sequence), path)
    store.prune(spark, path)


def apply_diffs(spark: SparkSession, path: str, fetch: Fetch, diffs: Iterable[Diff]) -> int:
    """All diffs of one timescale as one step. Their number is bounded by what catch_up asks for."""
    diffs = list(diffs)
    if not diffs:
        return 0
    folder = folders.shared(spark, "diffs")
    for d in diffs:
        raw = fetch(f"{d.timescale.lower()}/{path_of(d.sequence)}.osc.gz")
        if raw is None:
            raise LookupError(f"diff {d.sequence} of {d.timescale.lower()} is missing")
        with opened.write_to(f"{folder}/{path_of(d.sequence)}.osc.gz") as f:
            f.write(raw)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    advance(spark, path, changes_of(files), diffs[-1].timestamp, diffs[-1].sequence)
    return len(diffs)


def catch_up(spark: SparkSession, path: str, fetch: Fetch, now: float | None = None) -> int:
    """Days if the store is more than a day behind, then hours, then minutes."""
    when = store.load(spark, path).timestamp()
    check_timestamp(when)
    done = 0
    for timescale, behind in ((Timescale.DAY, 86400), (Timescale.HOUR, 3600), (Timescale.MINUTE, 0)):
        when = store.load(spark, path).timestamp()
        if (time.time() if now is None else now) - when > behind:
            done += apply_diffs(spark, path, fetch, find_diffs(fetch, timescale, when))
    return done


def poll(spark: SparkSession, path: str, fetch: Fetch, *, turns: int | None = None, sleep: Callable[[float], None] = time.sleep) -> None:
    """catch_up once a minute, on the minute."""
    while turns is None or turns > 0:
        began = time.time()
        catch_up(spark, path, fetch)
        turns = None if turns is None else turns - 1
        if turns != 0:
            sleep(max(0.0, 60 - (time.time() - began)))


def _state_beside(spark: SparkSession, diff: str) -> int | None:
    """Timestamp of the state file that lies beside a diff; None, which leaves the store's as it is, without one."""
    name = re.sub(r"\.osc(\.gz)?$", ".state.txt", diff)
    where = spark._jvm.org.apache.hadoop.fs.Path(name)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return parse_state(bytes(spark.read.format("binaryFile").load(name).first()["content"]).decode())[0]


def stream_changes(spark: SparkSession, folder: str, path: str, checkpoint: str, *, once: bool = False, every: str = "60 seconds"):
    """Diff files that appear in a folder, applied as they come: a streaming query. A batch that is run again changes nothing, as upserts and deletes are the same twice."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.osc*")
        .load(folder)
    )

    def apply(batch: DataFrame, _: int) -> None:
        names = [r["path"] for r in batch.select("path").collect()]  # one name a diff
        if not names:
            return
        seqs = sorted(sequence_of(n) for n in names)
        meta = store.load(spark, path).meta.first()
        last = meta["sequence_number"] or 0
        fresh = [s for s in seqs if s > last]
        if last and fresh and fresh != list(range(last + 1, last + 1 + len(fresh))):
            raise LookupError(f"diffs {fresh} do not follow {last}")
        if fresh:
            newest = next(n for n in names if sequence_of(n) == fresh[-1])
            advance(spark, path, changes_of(batch).where(F.col("seq") > last), _state_beside(spark, newest), fresh[-1])

    writer = files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def apply_document(spark: SparkSession, path: str, data: bytes, timestamp: int | None = None) -> None:
    """One osmChange document that is at hand."""
    rows = list(parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
    advance(spark, path, spark.createDataFrame(rows, CHANGES), timestamp, None)

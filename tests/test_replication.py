import gzip

import pytest

from terrane.functions.text import Timescale
from terrane.model import OsmDataset
from terrane.operators import segments
from terrane.streaming import replication, updater

START = 1600000000


def server(base, scale, first, count, width, body=lambda n: f'<osmChange><modify><node id="{n}" lat="1" lon="1"/></modify></osmChange>'):
    """Diffs first .. first + count - 1 of a timescale, each `width` seconds after the last; the one before the first is at START."""
    from datetime import datetime, timezone

    for n in range(first - 1, first + count):
        at = base / scale / f"{updater.path_of(n)}.state.txt"
        at.parent.mkdir(parents=True, exist_ok=True)
        when = datetime.fromtimestamp(START + width * (n - first + 1), timezone.utc)
        text = f"sequenceNumber={n}\ntimestamp={when:%Y-%m-%dT%H\\:%M\\:%SZ}\n"
        at.write_text(text)
        (base / scale / "state.txt").write_text(text)
        if n >= first:
            (base / scale / f"{updater.path_of(n)}.osc.gz").write_bytes(gzip.compress(body(n).encode()))


def offsets(first, last):
    return {"sequence": first, "timestamp": START}, {"sequence": last, "timestamp": START + 60 * last}


def test_plan_takes_the_coarsest_diffs(tmp_path):
    server(tmp_path, "day", 1, 2, 86400)
    server(tmp_path, "hour", 1, 50, 3600)
    server(tmp_path, "minute", 1, 3005, 60)
    scales = [Timescale.DAY, Timescale.HOUR, Timescale.MINUTE]
    found = replication.plan(str(tmp_path), scales, *offsets(-1, 3005))  # two days, two hours and five minutes
    assert [(d.timescale.lower(), d.sequence) for d in found] == [("day", 1), ("day", 2), ("hour", 49), ("hour", 50), *(("minute", n) for n in range(3001, 3006))]
    assert [d.timestamp for d in found] == sorted(d.timestamp for d in found)
    assert len(replication.plan(str(tmp_path), scales[-1:], *offsets(-1, 100))) == 100
    assert replication.plan(str(tmp_path), scales, {"sequence": 7, "timestamp": START + 420}, {"sequence": 7, "timestamp": START + 420}) == []


def test_a_gap_is_an_error(tmp_path):
    server(tmp_path, "minute", 1, 9, 60)
    (tmp_path / "minute" / "000" / "000" / "004.state.txt").unlink()
    with pytest.raises(LookupError, match="state 4"):
        replication.plan(str(tmp_path), [Timescale.MINUTE], *offsets(-1, 9))
    assert len(replication.plan(str(tmp_path), [Timescale.MINUTE], {"sequence": 5, "timestamp": START + 300}, offsets(0, 9)[1])) == 4
    with pytest.raises(ValueError):
        replication.ReplicationReader({"base": str(tmp_path), "timestamp": "5"})


def test_follow_survives_a_failure(spark, tmp_path):
    """Diff 3 of 5 can't be read: 1 and 2 stay as they are, nothing is applied twice, and the same query goes on afterwards."""
    path, base = str(tmp_path / "store"), tmp_path / "server"
    ds = OsmDataset.empty(spark)
    ds.meta = spark.createDataFrame([(START, 0)], "replication_timestamp bigint, sequence_number bigint")
    segments.create(ds, path)
    server(base, "minute", 1, 2, 60)
    run = lambda: replication.follow(spark, path, str(base), str(tmp_path / "offsets"), once=True, timescales="minute", compact=None)
    run().awaitTermination()
    assert segments.current(spark, path).number == 3 and segments.load(spark, path).nodes.count() == 2
    server(base, "minute", 1, 5, 60, lambda n: "<osmChange><modify><node" if n == 3 else f'<osmChange><modify><node id="{n}" lat="1" lon="1"/></modify></osmChange>')
    with pytest.raises(Exception, match="ParseError|no element found|unclosed"):
        run().awaitTermination()
    assert segments.current(spark, path).timestamp == START + 120
    server(base, "minute", 1, 5, 60)
    run().awaitTermination()
    v = segments.current(spark, path)
    assert (v.number, v.timestamp) == (6, START + 300)  # a version a diff: each was applied once
    assert sorted(r["id"] for r in segments.load(spark, path).nodes.collect()) == [1, 2, 3, 4, 5]
    run().awaitTermination()
    assert segments.current(spark, path).number == 6


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    path, base = str(tmp_path / "store"), tmp_path / "server"
    ds = OsmDataset.empty(spark)
    ds.meta = spark.createDataFrame([(START, 0)], "replication_timestamp bigint, sequence_number bigint")
    segments.create(ds, path)
    server(base, "minute", 1, 2, 60)
    spark.dataSource.register(replication.ReplicationSource)
    reader = replication.ReplicationReader({"base": str(base), "timestamp": str(START), "timescales": "minute"})
    rows = [r for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) for b in reader.read(p) for r in b.to_pylist()]
    batch = spark.createDataFrame(rows, replication.ROWS)
    assert replication.apply_batch(spark, path, batch) == [START + 60, START + 120]
    assert replication.apply_batch(spark, path, batch) == []


def test_keyed_state_takes_late_and_repeated_changes(spark, tmp_path, capsys):
    """Batches out of order: a late change changes nothing and is not told, a tombstone stays, one that is sent again is the first one; no row goes through Python."""
    from terrane.operators.changes import CHANGES
    from terrane.streaming import latest

    up = lambda seq, ord_, id_, lat, tags=None: (seq, ord_, "upsert", "NODE", id_, lat, -7, None, None, tags)
    gone = lambda seq, ord_, id_: (seq, ord_, "delete", "NODE", id_, None, None, None, None, None)
    batches = [
        [up(5, 1, 1, 10, [("a", "b"), ("a", "c")]), up(4, 8, 1, 9), gone(3, 1, 2), up(1, 1, 4, 40)],
        [up(5, 0, 1, 11), up(2, 9, 2, 20), up(1, 1, 3, 30, []), up(1, 1, 4, 41), (9, 9, "upsert", "NODE", None, 1, 1, None, None, None), up(9, 9, -1, 1)],
        [gone(6, 1, 3), (6, 2, "upsert", "WAY", 1, None, None, [3, 1, 3], None, [])],
    ]
    told = []

    def tell(df, _):
        told.append(sorted((r.type, r.id, r.seq, r.ord, r.op, r.fixed_lat, r.nodes) for r in latest.unpacked(spark, df).collect()))

    for rows in batches:
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "came"))
        stream = latest.last_change_stream(spark.readStream.schema(CHANGES).parquet(str(tmp_path / "came")))
        start = stream.writeStream.foreachBatch(tell).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start
        q = latest.with_rocksdb(spark, start)
        q.awaitTermination()
    stream.explain()
    assert "Py" not in capsys.readouterr().out
    assert told[0] == [("NODE", 1, 5, 1, "upsert", 10, None), ("NODE", 2, 3, 1, "delete", None, None), ("NODE", 4, 1, 1, "upsert", 40, None)]
    assert told[1] == [("NODE", 3, 1, 1, "upsert", 30, None)]
    assert told[2] == [("NODE", 3, 6, 1, "delete", None, None), ("WAY", 1, 6, 2, "upsert", None, [3, 1, 3])]
    held = {(r.type, r.id): r for r in latest.read_state(spark, str(tmp_path / "state")).collect()}
    assert sorted((*k, r.seq, r.op, r.fixed_lat) for k, r in held.items()) == [("NODE", 1, 5, "upsert", 10), ("NODE", 2, 3, "delete", None), ("NODE", 3, 6, "delete", None), ("NODE", 4, 1, "upsert", 40), ("WAY", 1, 6, "upsert", None)]
    assert [tuple(t) for t in held["NODE", 1].tags] == [("a", "b"), ("a", "c")] and held["NODE", 2].tags is None and held["WAY", 1].tags == []
    assert latest.read_state(spark, str(tmp_path / "state")).columns == spark.createDataFrame([], CHANGES).columns

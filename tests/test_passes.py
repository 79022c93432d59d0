"""How often work is done: views, stores and what follows from them are computed once."""

import os

import pytest
from pyspark.sql import functions as F

from terrane.functions.tags import get_tag
from terrane.model import RELATIONS, WAYS, OsmDataset
from terrane.operators import segments
from terrane.plans import fixtures
from terrane.plans.catalogue import _changed

DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@needs_tables
def test_entities_take_no_window_and_are_the_views(spark):
    ds = fixtures.dataset(spark, DIR)
    assert not any("Window" in plan(df) for df in (ds.nodes, ds.ways, ds.relations))
    same = lambda a, b: a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    view = lambda name: fixtures.view(spark, DIR, name)
    assert same(ds.nodes.select("id", "fixed_lat", "fixed_lon"), view("nodes"))
    assert same(ds.ways.select("id", F.posexplode("nodes")), view("way_refs"))
    assert same(ds.ways.select("id", *(get_tag(F.col("tags"), k) for k in ("highway", "building", "name"))), view("ways").drop("o_custkey"))
    assert same(ds.relations.select("id", F.inline("members")), view("members"))


def test_a_store_is_made_in_one_pass(spark, tmp_path):
    """Ranges of about one size whose bounds come from the rows as they are written, by as many tasks as asked for."""
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    nodes = spark.range(0, 40_000, 1, 8).select((F.col("id") * 3 - 50).alias("id"), F.lit(1).alias("fixed_lat"), F.lit(2).alias("fixed_lon"), fixtures.no_tags().alias("tags")).mapInArrow(note, "id long, fixed_lat int, fixed_lon int, tags " + fixtures.TAGS)
    none = (spark.createDataFrame([], WAYS), spark.createDataFrame([], RELATIONS))
    path = str(tmp_path / "store")
    v = segments.create(OsmDataset.of(nodes, *none), path, ranges=8, indexes=("counts",), parts=40)
    assert seen.value <= 2 * 40_000  # the sample of the shuffle, and the rows
    assert len(v.bounds["nodes"]) == 7 and set(v.base["nodes"]) == {str(r) for r in range(8)}
    for kind in ("nodes", "counts"):
        for r, at in v.base[kind].items():
            rows = spark.read.parquet(f"{path}/base/{at}")
            assert rows.where(segments.range_of(v.bounds[kind], F.col("id")) != int(r)).isEmpty() and 2500 < rows.count() < 10_000
    assert segments.load(spark, path).nodes.select("id").exceptAll(spark.range(40_000).select(F.col("id") * 3 - 50)).isEmpty()
    rows = spark.createDataFrame([(1, 0, "delete", "NODE", -50), (1, 1, "upsert", "NODE", 7)], "seq long, ord long, op string, type string, id long")
    after = segments.append(spark, path, _changed(spark, rows), sequence=1)
    assert "Aggregate" not in plan(segments._own(spark, path, after, "nodes"))  # a segment has one change of an id
    # Ids of fewer kinds than ranges leave no gap.
    few = segments.create(OsmDataset.of(nodes.where("id < -40"), *none), str(tmp_path / "few"), ranges=8, indexes=())
    assert len(few.bounds["nodes"]) + 1 == len(few.base["nodes"]) and segments.load(spark, str(tmp_path / "few")).nodes.count() == 4


def test_short_lists_are_coded_without_arrays(monkeypatch):
    """The same bytes as arrays give, without one for each way."""
    import numpy as np

    from terrane.sources import pbf, varint

    calls, whole = [], varint.pack
    monkeypatch.setattr(varint, "pack", lambda v: calls.append(1) or whole(v))
    list(pbf.encode("ways", [(i, [5, 3, -(1 << 62), 1 << 62], [("k", "v")]) for i in range(1000)]))
    assert len(calls) < 10
    for n in (0, 1, 5, 63, 64, 65, 300):
        some = [(k * 0x9E3779B97F4A7C15 & varint.U64) >> k % 64 for k in range(n)]
        signed = np.array(some, np.uint64).view(np.int64)
        assert varint.pack_list(some) == whole(np.array(some, np.uint64)) and varint.unpack_list(varint.pack_list(some)) == some
        assert varint.pack_deltas(signed.tolist()) == varint.pack_signed(np.diff(signed, prepend=0)) and varint.unpack_sums(varint.pack_deltas(signed.tolist())) == signed.tolist()
    for broken in (b"\x80", b"\x01\xff", b"\x80" * 10 + b"\x01"):
        with pytest.raises(ValueError, match="varint"):
            varint.unpack_list(broken)


@needs_tables
def test_entities_read_a_table_once(spark):
    ds = fixtures.dataset(spark, DIR)
    for df in (ds.nodes, ds.ways, ds.relations):
        assert sum("Relation [" in line and "l_orderkey" in line for line in plan(df).splitlines()) == 1

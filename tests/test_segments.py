import random

import pytest
from pyspark.sql import functions as F

from terrane.model import NODES, RELATIONS, WAYS, OsmDataset
from terrane.operators import analyze, changes, derived, index, segments
from terrane.sources import folders


def dataset(spark, n=2000):
    r = random.Random(1)
    nodes = [(i, 450000000 + r.randrange(10**7), -1230000000 + r.randrange(10**7), [("k", str(i))]) for i in range(1, n)]
    ways = [(i, [r.randrange(1, n) for _ in range(r.randrange(0, 5))], []) for i in range(1, n // 4)]
    relations = [(i, [("WAY", r.randrange(1, n // 4), "")], []) for i in range(1, n // 10)]
    return OsmDataset.of(*(spark.createDataFrame(x, s) for x, s in ((nodes, NODES), (ways, WAYS), (relations, RELATIONS))), 1600000000, 5)


def diff(spark, seq, n=2000, count=40, seed=0):
    r, rows = random.Random(seed), []
    for o in range(count):
        kind = r.choice(["NODE", "NODE", "WAY", "RELATION"])
        row = {"seq": seq, "ord": o, "op": r.choice(["upsert", "upsert", "delete"]), "type": kind, "id": r.randrange(1, n if kind == "NODE" else n // 4 if kind == "WAY" else n // 10)}
        if row["op"] == "upsert":
            row |= {"tags": [("v", str(seq))]}
            row |= {"fixed_lat": r.randrange(450000000, 460000000), "fixed_lon": -1225000000} if kind == "NODE" else {"nodes": [r.randrange(1, n + 50) for _ in range(r.randrange(0, 3))]} if kind == "WAY" else {"members": [("NODE", 3, "x")]}
        rows.append(tuple(row.get(c) for c in ("seq", "ord", "op", "type", "id", "fixed_lat", "fixed_lon", "nodes", "members", "tags")))
    return spark.createDataFrame(rows, changes.CHANGES)


def same(a, b):
    return analyze.differences(a, b).isEmpty()


def test_segments(spark, tmp_path):
    ds, path = dataset(spark), str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        segments.current(spark, path)
    segments.create(ds, path, ranges=8, indexes=("index", "counts"))
    with pytest.raises(FileExistsError):
        segments.create(ds, path)
    assert same(segments.load(spark, path), ds)
    want = ds
    for seq in (6, 7, 8):
        d = diff(spark, seq, seed=seq)
        segments.append(spark, path, d, 1600000000 + 60 * seq, seq)
        want = changes.apply_changes(want, d)
    now = segments.load(spark, path)
    assert same(now, want) and tuple(now.meta.first()) == (1600000480, 8)
    assert segments.append(spark, path, diff(spark, 7, seed=99), 1, 7).number == 4  # passed already
    rows = lambda df: sorted(map(tuple, df.select("xtile", "ytile", "way_id").collect()))
    assert rows(segments.load_index(spark, path)) == rows(index.tile_index(want.ways, want.nodes))
    counts = lambda df: sorted(map(tuple, df.select("id", "refs", "all_refs", "present").collect()))
    assert counts(segments.load_counts(spark, path)) == counts(derived.counts(want.ways, want.nodes))
    ids = lambda df, c: sorted(r[c] for r in df.select(c).collect())
    assert ids(segments.load_counts(spark, path).where(derived.intersection()), "id") == ids(analyze.intersection_nodes(want.ways), "node_id")
    assert ids(segments.load_counts(spark, path).where(derived.referenced()), "id") == ids(analyze.referenced_nodes(want.ways), "node_id")
    asked = spark.createDataFrame([(i,) for i in (3, 5, 9, 9, 10**9, None)], "id long")
    assert sorted(map(str, segments.look_up(spark, path, "nodes", asked).collect())) == sorted(map(str, want.nodes.where("id in (3, 5, 9)").select("id", "fixed_lat", "fixed_lon", "tags").collect()))
    # An older version is still there, whole.
    assert same(segments.load(spark, path, 1), ds)
    done = segments.compact(spark, path, share=0)
    assert done.segments == [] and same(segments.load(spark, path), want) and rows(segments.load_index(spark, path)) == rows(index.tile_index(want.ways, want.nodes))
    assert counts(segments.load_counts(spark, path)) == counts(derived.counts(want.ways, want.nodes))
    segments.vacuum(spark, path, keep=1)
    assert same(segments.load(spark, path), want) and folders.names(spark, f"{path}/segments") == [] and segments.versions(spark, path) == [5]


def test_a_diff_writes_little(spark, tmp_path):
    """150 changes, next to each other, cost under a twentieth of the store's bytes, compaction of their ranges included."""
    ds, path = dataset(spark, 40_000), str(tmp_path / "store")
    segments.create(ds, path, ranges=64)
    bytes_of = lambda: folders.size(spark, f"{path}/base") + folders.size(spark, f"{path}/segments")
    whole = bytes_of()
    d = spark.createDataFrame([(6, i, "upsert", "NODE", 20_000 + i, 451000000, -1225000000, None, None, [("v", str(i))]) for i in range(150)], changes.CHANGES)
    segments.append(spark, path, d, 1600000060, 6)
    before = segments.current(spark, path)
    v = segments.compact(spark, path)
    rewritten = {(k, r) for k, b in v.base.items() for r, at in b.items() if before.base[k][r] != at}
    assert {k for k, _ in rewritten} == {"nodes"} and 1 <= len(rewritten) <= 2  # the ways' index has too few changes to be rewritten
    assert bytes_of() - whole < 0.05 * whole
    assert same(segments.load(spark, path), changes.apply_changes(ds, d))


def test_a_lost_job_leaves_the_store_as_it_was(spark, tmp_path):
    ds, path = dataset(spark, 400), str(tmp_path / "store")
    segments.create(ds, path, ranges=4)
    broken = diff(spark, 6, 400).withColumn("seq", F.when(F.col("ord") == 39, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("seq")))
    with pytest.raises(Exception, match="lost"):
        segments.append(spark, path, broken, 1600000060, 6)
    assert same(segments.load(spark, path), ds)
    v = segments.current(spark, path)
    segments._commit(spark, path, segments.Version(2, 0, 0, v.bounds, v.base))
    with pytest.raises(FileExistsError):
        segments._commit(spark, path, segments.Version(2, 0, 0, v.bounds, v.base))


def test_a_store_of_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    segments.create(OsmDataset.empty(spark), path, indexes=())
    with pytest.raises(LookupError):
        segments.load_counts(spark, path)
    with pytest.raises(ValueError):
        segments.create(OsmDataset.empty(spark), path + "2", indexes=("speeds",))
    assert segments.load(spark, path).counts().first() == (0, 0, 0)
    d = diff(spark, 1, 50)
    segments.append(spark, path, d, 60, 1)
    assert same(segments.load(spark, path), changes.apply_changes(OsmDataset.empty(spark), d))

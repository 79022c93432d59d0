import os
import random

import pytest
from pyspark.sql import functions as F

from terrane.model import NODES, RELATIONS, WAYS, OsmDataset
from terrane.operators.analyze import differences
from terrane.sources import files, formats, opened


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(4)
    nodes = [(i * 3, r.randrange(10**8), -r.randrange(10**8), [("k", "v" * r.randrange(5))] * r.randrange(3)) for i in range(30_000)]
    ways = [(i, [r.randrange(90_000) for _ in range(r.randrange(6))], [("name", f"é{i}")]) for i in range(9000)]
    relations = [(i, [("WAY", r.randrange(9000), "outer"), ("RELATION", i, "")], []) for i in range(50)]
    return OsmDataset.of(*(spark.createDataFrame(x, s) for x, s in ((nodes, NODES), (ways, WAYS), (relations, RELATIONS))), 1600000000, 7)


def ids_of(df):
    return [r["id"] for r in df.select("id").collect()]


@pytest.mark.parametrize("fmt", ["pbf", "vex"])
def test_parts(spark, data, tmp_path, fmt):
    path = str(tmp_path / "out")
    files.save_parts(data, path, fmt, 3)
    back = files.load_osm(spark, path)
    assert differences(data, back).isEmpty() and tuple(back.meta.first()) == (1600000000, 7)
    assert ids_of(back.nodes) == [i * 3 for i in range(30_000)]  # parts in order, each sorted
    assert len([n for n in os.listdir(f"{path}/nodes") if n.endswith(fmt)]) == 3
    with pytest.raises(FileExistsError):
        files.save_parts(data, path, fmt)
    one = str(tmp_path / f"all.{fmt}")
    files.join_parts(path, one)
    assert differences(data, files.load_osm(spark, one)).isEmpty()
    assert files.load_osm(spark, one).timestamp() == (1600000000 if fmt == "pbf" else 0)


@pytest.mark.parametrize("fmt", ["pbf", "vex"])
def test_filters_choose_blocks(spark, data, tmp_path, fmt):
    files.save_osm(data, one := str(tmp_path / f"all.{fmt}"))
    reading = formats.PbfReader if fmt == "pbf" else formats.VexReader

    def blocks(entity, **options):
        return [b for p in reading({"path": one, "entity": entity, **options}).partitions() for b in p.blocks]

    everything = len(blocks("nodes"))
    told = formats.index_file(spark, one).collect()
    own = {k: [r for r in told if r["kind"] == k] for k in formats.KINDS}
    assert sum(r["count"] for r in own["nodes"]) == 30_000 and sum(r["count"] for r in own["ways"]) == 9000
    # With the directory, a kind reads its own blocks only, and bounds of ids those that can hold one.
    assert len(blocks("nodes")) == len(own["nodes"]) <= everything and len(blocks("relations")) == 1
    assert len(blocks("nodes", low="300", high="300")) == 1 and blocks("nodes", low="90000") == []
    assert len(blocks("nodes", high="59950")) == sum(r["low"] <= 59_950 for r in own["nodes"])
    assert fmt == "vex" or len(blocks("nodes", high="59950")) < len(own["nodes"])
    assert differences(data, files.load_osm(spark, one)).isEmpty()


@pytest.mark.parametrize("parts", [True, False])
def test_look_up(spark, data, tmp_path, monkeypatch, parts):
    path = str(tmp_path / "x.pbf")
    if parts:
        files.save_parts(data, path, "pbf", 5)
        path += "/nodes"
    else:
        files.save_osm(data, path)
        formats.index_file(spark, path)
    asked = spark.createDataFrame([(i,) for i in (0, 3, 4, 3, 60_000, -5, 10**12, None)], "id long")
    found = formats.look_up(spark, path, "nodes", asked)
    assert sorted(ids_of(found)) == [0, 3, 60_000]
    chosen = []
    plain = formats._Reader._pieces
    monkeypatch.setattr(formats._Reader, "_pieces", lambda self, *a: chosen.extend(out := plain(self, *a)) or out)
    n = sum(len(p.blocks) for f in ([path] if not parts else [f"{path}/{p['name']}" for p in formats.read_parts(path)]) for p in formats.PbfReader({"path": f})._pieces(f, formats.read_directory(f)))
    many = spark.range(0, 30_000).select("id")
    assert formats.look_up(spark, path, "nodes", many).count() == 10_000 and n >= 4
    none = formats.look_up(spark, path, "nodes", spark.createDataFrame([(1,), (10**9,)], "id long"))
    assert none.count() == 0


def test_look_up_reads_only_blocks_that_can_hold_an_id(spark, tmp_path):
    """A block that is broken is not met by ids of others."""
    nodes = spark.range(300_000).selectExpr("id", "cast(1 as int) fixed_lat", "cast(2 as int) fixed_lon", f"cast(null as {NODES.split('tags ')[1]}) tags")
    path = str(tmp_path / "x.vex")
    files.save_osm(OsmDataset.of(nodes, *(spark.createDataFrame([], s) for s in (WAYS, RELATIONS))), path)
    directory = formats.index_file(spark, path).orderBy("low").collect()
    bad = directory[0]
    with open(path, "r+b") as f:
        f.seek(bad["offset"])
        f.write(b"\0" * bad["size"])
    assert len(directory) > 1
    assert formats.look_up(spark, path, "nodes", spark.createDataFrame([(bad["high"] + 1,)], "id long")).count() == 1
    with pytest.raises(Exception, match="zlib|Error -3"):
        formats.look_up(spark, path, "nodes", spark.createDataFrame([(bad["low"],)], "id long")).count()


def test_a_failed_task_leaves_nothing(spark, data, tmp_path):
    path = str(tmp_path / "out")
    formats.register(spark)
    write = lambda df, mode: df.write.format("vex").option("path", path).option("entity", "nodes").mode(mode).save()
    good = data.nodes.where("id < 3000").repartition(2, "id")
    write(good, "overwrite")
    before, listed = sorted(n for n in os.listdir(path) if not n.startswith(".")), formats.read_parts(path)
    broken = data.nodes.repartition(4, "id").withColumn("fixed_lat", F.when(F.col("id") == 60_000, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("fixed_lat")))
    with pytest.raises(Exception, match="lost"):
        write(broken, "append")
    assert formats.read_parts(path) == listed
    formats.tidy(path)  # tasks that were still writing when the job was given up
    assert sorted(n for n in os.listdir(path) if not n.startswith(".")) == before
    read = lambda: spark.read.format("vex").option("path", path).option("entity", "nodes").load()
    assert read().count() == 1000
    write(data.nodes.where("id between 3000 and 5999"), "append")
    assert read().count() == 2000
    write(data.nodes.where("id < 30"), "overwrite")
    assert read().count() == 10


def test_text_parts_and_empty(spark, data, tmp_path):
    files.save_parts(data, str(tmp_path / "t"), "txt", 2)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "t" / "relations")).collect()]
    assert sorted(lines) == sorted(f"R {i} " for i in range(50))
    files.save_parts(OsmDataset.empty(spark), str(tmp_path / "e"), "pbf")
    assert files.load_osm(spark, str(tmp_path / "e")).counts().first() == (0, 0, 0)
    files.join_parts(str(tmp_path / "e"), str(tmp_path / "e.pbf"))
    assert files.load_osm(spark, str(tmp_path / "e.pbf")).counts().first() == (0, 0, 0)
    with pytest.raises(FileNotFoundError):
        files.load_osm(spark, str(tmp_path / "none.pbf"))
    assert opened.at("file:///x/y")[1] == "/x/y"

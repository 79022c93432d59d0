import io
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrane.functions.tags import no_tags
from terrane.model import MEMBERS, NODES, RELATIONS, WAYS, OsmDataset
from terrane.operators.analyze import differences
from terrane.sources import files, formats, pbf, varint, vex

NODE = (5_000_000_000, 471000000, -1222000000, [("a", "b"), ("a", ""), ("név", "🎉")])
NODE_LIST = [(9, -900000000, 1800000000, []), (3, 0, 0, []), NODE]
WAY_LIST = [(1, [], []), (2, [5, 5, 3, 5_000_000_000], [("highway", "x")])]
RELATION_LIST = [(1, [("NODE", 3, ""), ("WAY", 2, "outer"), ("RELATION", 1, "self")], [("type", "t")]), (2, [], [])]
ALL = {"nodes": NODE_LIST, "ways": WAY_LIST, "relations": RELATION_LIST}


@given(st.lists(st.integers(-(2**63), 2**63 - 1)))
@settings(max_examples=50, deadline=None)
def test_varints(values):
    raw = varint.pack_signed(np.array(values, np.int64))
    assert varint.unpack_signed(raw).tolist() == values
    r = varint.Reader(raw)
    assert [r.signed() for _ in values] == values
    w = varint.Writer()
    for v in values:
        w.signed(v)
    assert bytes(w.data) == raw


def test_varint_errors():
    for bad in (b"\x80", b"\xff" * 11):
        with pytest.raises(ValueError):
            varint.unpack(bad)
        with pytest.raises(ValueError):
            varint.Reader(bad).unsigned()
    assert varint.Reader(varint.pack(np.array([2**40 + 5], np.uint64))).unsigned32() == 5


def through_vex(kind, entities, **kw):
    f = io.BytesIO(b"".join(vex.encode(kind, entities)))
    out = []
    for k, n, at, size in list(vex.blocks(f)):
        f.seek(at)
        out += [(k, e) for e in vex.decode(k, n, f.read(size), **kw)]
    return out


def through_pbf(kind, entities):
    f = io.BytesIO(b"".join(pbf.encode(kind, entities)))
    out, sizes = [], []
    for _, at, size in list(pbf.frames(f)):
        f.seek(at)
        out.append(list(pbf.decode(pbf.inflate(f.read(size)), kind)))
        sizes.append(len(out[-1]))
    return [e for b in out for e in b], sizes


@pytest.mark.parametrize("kind", ALL)
def test_codecs(kind):
    assert through_vex(kind, ALL[kind]) == [(kind, e) for e in ALL[kind]]
    assert through_pbf(kind, ALL[kind])[0] == ALL[kind]
    for few in ([], ALL[kind][:1]):
        assert through_pbf(kind, few)[0] == few


@pytest.mark.parametrize("n", [7999, 8000, 8001, 8002, 16001])
def test_pbf_blocks(n):
    got, sizes = through_pbf("nodes", [(i * 3, i, -i, []) for i in range(n)])
    assert len(got) == n and max(sizes) <= pbf.BLOCK and got[-1] == ((n - 1) * 3, n - 1, 1 - n, [])


def test_vex_limits_and_padding():
    node = lambda tags: [(1, 0, 0, tags)]
    assert through_vex("nodes", node([("k", "x" * 1024)]))
    assert through_vex("nodes", node([("k", "x")] * 500))
    for bad in (node([("k", "x" * 1025)]), node([("k", "x")] * 501)):
        with pytest.raises(ValueError):
            through_vex("nodes", bad)
        assert through_vex("nodes", bad, limits=False)
    block = next(vex.encode("nodes", node([])))
    padded = zlib.compress(zlib.decompress(block[12:]) + bytes(1000))
    assert list(vex.decode("nodes", 1, padded)) == node([])
    with pytest.raises(ValueError):
        list(vex.blocks(io.BytesIO(b"VEXN" + struct.pack(">ii", -1, 5))))
    big = [(i, 0, 0, [("k", "v" * 900)]) for i in range(3000)]
    assert [e for _, e in through_vex("nodes", big)] == big


def test_vex_large_entities():
    """Relations of half a block, which do not fit where others have been put, and one that is larger than a block, even deflated."""
    ids = np.random.default_rng(1).integers(0, 2**62, 200_000).tolist()
    members = lambda n: [("RELATION", i, "subarea") for i in ids[:n]]
    relations = [(1, members(20_000), []), *((2 + i, members(36_000), [("type", "t")]) for i in range(3)), (9, members(200_000), []), (10, members(5), [])]
    assert [e for _, e in through_vex("relations", relations)] == relations
    found = [(n, size) for _, n, _, size in vex.blocks(io.BytesIO(b"".join(vex.encode("relations", relations))))]
    assert all(size <= vex.SIZE for n, size in found if n > 1) and max(size for _, size in found) > vex.SIZE
    with pytest.raises(ValueError):
        list(vex.blocks(io.BytesIO(b"VEXR" + struct.pack(">ii", 2, vex.SIZE + 1))))


def test_pbf_raw_blob_granularity_and_features():
    body = pbf.message((1, pbf.message((1, ""))), (2, pbf.message((2, pbf.message((1, varint.pack_signed([7])), (8, varint.pack_signed([1000])), (9, varint.pack_signed([-1000])))))), (17, 1000), (19, 500), (20, 0))
    assert pbf.inflate(pbf.message((1, body))) == body
    assert list(pbf.decode(body, "nodes")) == [(7, (1000 * 1000 + 500) // 100, -10000, [])]
    plain = pbf.message((1, pbf.message((1, ""), (1, "k"), (1, "v"))), (2, pbf.message((1, pbf.message((1, varint.zigzag(-4)), (2, b"\x01"), (3, b"\x02"), (8, varint.zigzag(5)), (9, varint.zigzag(-6)))))))
    assert list(pbf.decode(plain, "nodes")) == [(-4, 5, -6, [("k", "v")])]
    with pytest.raises(ValueError):
        pbf.read_header(pbf.message((4, "HistoricalInformation")))


@pytest.fixture(scope="module")
def data(spark):
    d = lambda rows, s: spark.createDataFrame(rows, s)
    return OsmDataset.of(d(NODE_LIST, NODES), d(WAY_LIST, WAYS), d(RELATION_LIST, RELATIONS), 1600000000, 42)


@pytest.mark.parametrize("fmt", ["pbf", "vex"])
def test_files(spark, data, tmp_path, fmt):
    path = str(tmp_path / f"x.osm.{fmt}")
    files.save_osm(data, path)
    back = files.load_osm(spark, path)
    assert differences(data, back).count() == 0
    assert back.timestamp() == (1600000000 if fmt == "pbf" else 0)
    assert [r["id"] for r in back.nodes.collect()] == sorted(e[0] for e in NODE_LIST)
    assert files.load_osm(spark, path, keys=["none"]).nodes.where("size(tags) > 0").count() == 0
    again = str(tmp_path / "y.pbf")
    files.convert(spark, path, again)
    assert differences(data, files.load_osm(spark, again)).count() == 0
    assert files.load_osm(spark, again).timestamp() == back.timestamp()


def test_large_relations_in_parts(spark, tmp_path):
    """Blocks that end before an entity that does not fit count and bound only their own."""
    some = F.transform(F.sequence(F.lit(1), F.when(F.col("id") < 3000, 10).otherwise(36_000)), lambda i: F.struct(F.lit("WAY").alias("type"), (i + F.col("id") * 100_000).alias("id"), F.lit("subarea").alias("role")))
    relations = spark.range(3008).select("id", some.cast(MEMBERS).alias("members"), no_tags().alias("tags"))
    empty = OsmDataset.empty(spark)
    for fmt in ("vex", "pbf"):
        path = str(tmp_path / fmt)
        files.save_parts(OsmDataset(empty.nodes, empty.ways, relations, empty.meta), path, fmt, 1)
        back = files.load_osm(spark, path).relations
        assert back.count() == 3008 and back.exceptAll(relations).count() == 0
        (part,) = formats.read_parts(f"{path}/relations")
        blocks = formats.read_directory(f"{path}/relations/{part['name']}")
        assert sum(b.count for b in blocks) == 3008 and all(a.high < b.low for a, b in zip(blocks, blocks[1:]))


def test_empty_and_text(spark, data):
    for fmt in ("pbf", "vex"):
        back = files.decode_bytes(spark, fmt, files.encode_bytes(OsmDataset.empty(spark), fmt))
        assert tuple(back.counts().first()) == (0, 0, 0)
    lines = files.encode_bytes(data, "txt").decode().split("\n")
    assert lines[0] == files.BEGIN and lines[-1] == files.END
    assert lines[1:4] == ["N 3 0.000000 0.000000 ", "N 9 -90.000000 180.000000 ", "N 5000000000 47.100000 -122.200000 a=b;a=;név=🎉;"]
    assert lines[4:8] == ["W 1 ", "W 2 highway=x;", "R 1 type=t;", "R 2 "]
    with pytest.raises(ValueError):
        files.convert(spark, "a.pbf", "b.xml")

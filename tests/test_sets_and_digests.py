import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.model import NODES, RELATIONS, WAYS, OsmDataset
from terrane.operators import analyze, digests, idsets
from terrane.sources import osmchange


def test_forms():
    r = np.random.default_rng(1)
    for low, form in ((r.choice(65536, 100, False), "array"), (np.arange(500, 40_000), "run"), (r.choice(65536, 30_000, False), "bitmap"), (np.array([65535]), "array"), (np.arange(65536), "run"), (np.array([0, 1, 2]), "run")):
        low = np.sort(low).astype(np.int64)
        got, data = idsets.pack(low)
        assert got == form and (idsets.unpack(got, data) == low).all()
    assert len(idsets.pack(np.array([7]))[1]) == 2  # a lone id


def test_algebra(spark):
    r = random.Random(2)
    a = {r.randrange(10**6) for _ in range(3000)} | set(range(200_000, 280_000)) | {10**12 + 7, -5, -70_000} | set(range(2**20, 2**20 + 131_072, 2))
    b = {r.randrange(10**6) for _ in range(3000)} | set(range(240_000, 300_000)) | {10**12 + 7, 10**13}
    frame = lambda s: spark.createDataFrame([(i,) for i in s] + [(None,), (next(iter(s)),)], "x long")
    x, y = idsets.build(frame(a), "x"), idsets.build(frame(b), "x")
    ids = lambda s: {r["id"] for r in idsets.ids_of(s).collect()}
    assert ids(x) == a and idsets.cardinality(x).first()["n"] == len(a)
    for got, want in ((idsets.either(x, y), a | b), (idsets.both(x, y), a & b), (idsets.without(x, y), a - b), (idsets.without(y, x), b - a)):
        assert ids(got) == want and idsets.cardinality(got).first()["n"] == len(want)
    asked = {*list(a)[:200], *list(b)[:200], -10**9, 0, 10**12, 10**15, 2**31}
    order = np.sort(np.array(list(a), np.int64))
    for row in idsets.ranks(x, frame(asked), "x").collect():
        assert row["inside"] == (row["id"] in a) and row["rank"] == np.searchsorted(order, row["id"], "right")
    none = idsets.build(spark.createDataFrame([], "x long"), "x")
    assert ids(idsets.either(none, y)) == b and ids(idsets.both(none, y)) == set() and idsets.ranks(none, frame({5}), "x").first()["rank"] == 0
    sparse = idsets.build(spark.range(1000).select((F.col("id") * 10**6).alias("x")), "x")
    assert idsets.bytes_of(sparse).first()["bytes"] == 2000  # bitmaps of buckets take 8 KB each


def test_digest_trees(spark):
    nodes = [(i, i, i, [("a", str(i))] if i % 3 else None) for i in range(0, 20_000, 2)] + [(2**62, 1, 1, []), (-9, 1, 1, [])]
    make = lambda rows: OsmDataset.of(spark.createDataFrame(rows, NODES), spark.createDataFrame([(1, [2, 3], [])], WAYS), spark.createDataFrame([(1, [("WAY", 1, "x")], [])], RELATIONS))
    a = make(nodes)
    same = make([(*n[:3], n[3] or []) for n in nodes[::-1]])
    assert digests.differing(digests.tree(a), digests.tree(same)).isEmpty()
    changed = [n for n in nodes if n[0] not in (2**62, 4000)] + [(5001, 0, 0, [])]
    changed = [(i, la, lo, [("b", "")] if i == 100 else t) for i, la, lo, t in changed] + [(600, 600, 600, None)]
    b = make(changed)
    leaves = digests.differing(digests.tree(a), digests.tree(b))
    assert {tuple(r) for r in leaves.collect()} == {("nodes", i >> 8) for i in (2**62, 4000, 5001, 100, 600)}
    got = sorted(map(tuple, digests.differences(a, b).collect()))
    assert got == sorted(map(tuple, analyze.differences(a, b).collect())) and len(got) == 6


def document(n, seed):
    r, out = random.Random(seed), ['<?xml version="1.0"?>\n<osmChange version="0.6">\n']
    for i in range(n):
        if r.random() < 0.3 or not i:
            out.append((f"</{op}>" if i else "") + f"<{(op := r.choice(['create', 'modify', 'delete', 'Add']))}>\n")
        if r.random() < 0.05:
            out.append("<!-- a comment & more -->")
        kind = r.choice(["node", "way", "relation"])
        if kind == "node":
            out.append(f'<node id="{i}" lat="1.5" lon="{i % 90}"/>\n' if r.random() < 0.5 else f'<node id="{i}" lat="2" lon="3"><tag k="é" v="{"x" * r.randrange(60)}&lt;node"/></node>\n')
        elif kind == "way":
            out.append(f'<way id="{i}">' + "".join(f'<nd ref="{r.randrange(99)}"/>' for _ in range(r.randrange(9))) + "</way>\n")
        else:
            out.append(f'<relation id="{i}"><member type="way" ref="{i}" role="outer"/><tag k="a" v="b"/></relation>')
    return "".join(out) + f"</{op}></osmChange>\n"


@pytest.mark.parametrize("size", [37, 500, 4096, 1 << 20])
def test_pieces_of_a_document(spark, tmp_path, size):
    path = tmp_path / "big.osc"
    path.write_text(document(400 if size > 100 else 60, size), encoding="utf-8")
    want = list(osmchange.parse(path.read_bytes(), 9))
    got = [r.asDict(True) for r in osmchange.read_large(spark, str(path), 9, size).orderBy("ord").collect()]
    assert got == want and [r["ord"] for r in got] == list(range(len(want)))


def test_a_node_without_coordinates_in_a_piece(spark, tmp_path):
    path = tmp_path / "bad.osc"
    path.write_text("<osmChange><delete>" + '<node id="1"/>' * 50 + "</delete><modify>" + '<way id="2"/>' * 50 + '<node id="3"/></modify></osmChange>')
    with pytest.raises(Exception, match="no coordinates"):
        osmchange.read_large(spark, str(path), 1, 100).collect()

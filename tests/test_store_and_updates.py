import gzip
import threading
import urllib.error
import urllib.request

import pytest

from terrane.functions.text import Timescale
from terrane.model import NODES, RELATIONS, WAYS, OsmDataset
from terrane.operators import analyze, changes, enrich, extract, index, store
from terrane.server import serve
from terrane.sources import osmchange
from terrane.streaming import updater

# Four points in one tile, one far off.
POINTS = [(1, 450000000, -1220000000, None), (2, 450001000, -1220001000, []), (3, 450002000, -1220002000, []), (4, 300000000, 100000000, []), (9, 450000000, -1220000000, [])]
LINES = [(10, [1, 2, 3], [("highway", "a")]), (11, [3, 4, 3], [("building", "no")]), (12, [4, 1], []), (13, [], []), (14, [99, 1], []), (15, [2, 3, 2], [])]
GROUPS = [(20, [("WAY", 10, "x")], []), (21, [("RELATION", 20, "")], []), (22, [("RELATION", 21, ""), ("RELATION", 22, "self")], []), (23, [("NODE", 4, "")], []), (24, [("NODE", 10, "")], []), (25, [("WAY", 12, "")], [])]
BOX = (44.99, -122.01, 45.01, -121.99)

DIFF = """<osmChange><create><node id="50" lat="45.0" lon="-122.0"><tag k="n" v="1"/></node></create>
<Modify><way id="10"><nd ref="50"/><nd ref="1"/></way><relation id="20"><member type="way" ref="10" role="r"/><member type="node" ref="50" role=""/></relation></Modify>
<delete><node id="9"/><node lat="1" lon="1"/></delete><modify><node id="4" lat="45.0" lon="-122.0"/></modify></osmChange>"""


@pytest.fixture(scope="module")
def data(spark):
    d = lambda rows, s: spark.createDataFrame(rows, s)
    return OsmDataset.of(d(POINTS, NODES), d(LINES, WAYS), d(GROUPS, RELATIONS), 1600000000, 5)


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_index_and_analyses(spark, data):
    assert ids(index.tile_index(data.ways, data.nodes), "way_id") == [10, 11, 12, 15]
    assert ids(analyze.referenced_nodes(data.ways), "node_id") == [1, 2, 3, 4, 99]
    assert ids(analyze.intersection_nodes(data.ways), "node_id") == [1, 2, 3]
    assert [tuple(r) for r in analyze.relation_index(data.relations, "WAY").orderBy("member_id").collect()] == [(10, 20), (12, 25)]
    weights = {r["string"]: r["weight"] for r in analyze.string_weights(data).collect()}
    assert weights == {"highway": 7, "a": 1, "highway=a": 9, "building": 8, "no": 2, "building=no": 11}


@pytest.mark.parametrize("low", [2**6, 2**16, 2**34, 2**50])
def test_cardinality(spark, low):
    values = [i * i + low for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values + values[:10]], "id bigint")
    assert analyze.cardinality(df, "id").first()["n"] == len(set(values))


def test_extract(spark, data):
    got = extract.extract(data, BOX)
    assert ids(got.ways) == [10, 11, 15] and ids(got.nodes) == [1, 2, 3, 4]
    assert ids(got.relations) == [20, 21, 22, 23]  # parents, over a cycle, and one by its node
    old = extract.extract(data, BOX, compat=True)
    assert ids(old.relations) == [20, 24]  # nodes looked up by the ids of ways, parents not followed
    assert ids(extract.extract(OsmDataset.empty(spark), BOX).relations) == []


def test_changes(spark, data):
    rows = spark.createDataFrame(list(osmchange.parse(DIFF.encode(), 6)), changes.CHANGES)
    assert rows.count() == 5  # the delete without an id is left out
    got = changes.apply_changes(data, rows, 1600000060, 6)
    assert ids(got.nodes) == [1, 2, 3, 4, 50]
    way = got.ways.where("id = 10").first()
    assert way["nodes"] == [50, 1] and way["tags"] == []
    assert [tuple(m) for m in got.relations.where("id = 20").first()["members"]] == [("WAY", 10, "r"), ("NODE", 50, "")]
    before, after = index.tile_index(data.ways, data.nodes), index.tile_index(got.ways, got.nodes)
    assert ids(changes.reindexed(before, after), "way_id") == [12]  # its first node moved
    assert tuple(got.meta.first()) == (1600000060, 6)
    with pytest.raises(ValueError):
        list(osmchange.parse(b'<osmChange><create><node id="1"/></create></osmChange>'))


def test_speeds(spark, data, tmp_path):
    (tmp_path / "s.csv").write_text("way_id,speed_kph\n10,12.25\n10,30\n777,5\n")
    got = enrich.set_speeds(data.ways, enrich.read_speeds(spark, str(tmp_path / "s.csv")))
    tags = {r["id"]: [tuple(t) for t in r["tags"]] for r in got.collect()}
    assert tags[10] == [("highway", "a"), ("maxspeed:motorcar", "30.0 kph")] and tags[12] == []


def test_store(spark, data, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        store.load(spark, path)
    store.save(data, path)
    with pytest.raises(FileExistsError):
        store.save(data, path)
    assert analyze.differences(data, store.load(spark, path)).count() == 0
    assert ids(store.by_id(store.load(spark, path).nodes, 2, 77)) == [2]
    found = extract.in_tiles(store.load_index(spark, path), 659, 1473, 659, 1473)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(xtile" in plan and "PushedFilters: [IsNotNull(ytile)" in plan
    assert ids(extract.extract(store.load(spark, path), BOX, index=store.load_index(spark, path)).ways) == [10, 11, 15]


def replication(base):
    """Minute diffs 6 and 7 after a store at sequence 5."""
    folder = base / "minute" / "000" / "000"
    folder.mkdir(parents=True)
    for n, body in ((6, DIFF), (7, '<osmChange><delete><node id="50"/></delete></osmChange>')):
        (folder / f"{n:03d}.osc.gz").write_bytes(gzip.compress(body.encode()))
    for n in (5, 6, 7):
        text = f"#comment\nsequenceNumber={n}\ntimestamp=2020-09-13T12\\:{26 + n - 5}\\:40Z\n"
        (folder / f"{n:03d}.state.txt").write_text(text)
        (base / "minute" / "state.txt").write_text(text)
    return updater.fetch_from(str(base))


def test_polling(spark, data, tmp_path):
    path, fetch = str(tmp_path / "store"), replication(tmp_path / "r")
    store.save(data, path)
    diffs = updater.find_diffs(fetch, Timescale.MINUTE, 1600000000)
    assert [(d.sequence, d.timestamp) for d in diffs] == [(6, 1600000060), (7, 1600000120)]
    assert sorted(tuple(r)[1:] for r in osmchange.read_states(spark, str(tmp_path / "r" / "minute" / "000")).collect()) == [(5, 1600000000), (6, 1600000060), (7, 1600000120)]
    assert updater.catch_up(spark, path, fetch, now=1600000200) == 2
    now = store.load(spark, path)
    assert ids(now.nodes) == [1, 2, 3, 4] and tuple(now.meta.first()) == (1600000120, 7)
    assert updater.catch_up(spark, path, fetch, now=1600000200) == 0
    (tmp_path / "r" / "minute" / "000" / "000" / "006.state.txt").unlink()
    with pytest.raises(LookupError):
        updater.find_diffs(fetch, Timescale.MINUTE, 1600000000)
    with pytest.raises(ValueError):
        updater.check_timestamp(0)


def test_stream(spark, data, tmp_path):
    path = str(tmp_path / "store")
    replication(tmp_path / "r")
    store.save(data, path)
    for _ in range(2):  # the second finds nothing new
        q = updater.stream_changes(spark, str(tmp_path / "r"), path, str(tmp_path / "cp"), once=True)
        q.awaitTermination()
        assert q.exception() is None
    now = store.load(spark, path)
    assert ids(now.nodes) == [1, 2, 3, 4] and tuple(now.meta.first()) == (1600000120, 7)


def test_id_sets(spark):
    """Marks against a set, at the borders of bytes and buckets; negative ids too."""
    held = {1, 2, 7, 8, 9, 32768, 32769, 65536, 10**12, -5, -32768}
    s = analyze.IdSet(spark.createDataFrame([(i,) for i in held] + [(None,), (7,)], "x long"), "x")
    asked = spark.createDataFrame([(i,) for h in held for i in (h - 1, h, h + 1)] + [(None,)], "id long")
    assert all(r["inside"] == (r["id"] in held) for r in s.mark(asked, "id", "inside").collect())
    assert analyze.EveryId().mark(asked, "id", "inside").where("not inside").collect() == [(None, False)]


def test_sink(data):
    from terrane.sources.sink import EntitySink, send

    said = []

    class Counts(EntitySink):
        def begin(self, ds):
            said.append(ds.timestamp())

        def ways(self, ways):
            said.append(ways.count())

        def end(self):
            said.append("end")

    send(data, Counts())
    assert said == [1600000000, len(LINES), "end"]


def test_only_a_missing_file_is_nothing(monkeypatch):
    def fail(code):
        def opened(at):
            raise urllib.error.HTTPError(at, code, "", {}, None)

        return opened

    monkeypatch.setattr(urllib.request, "urlopen", fail(404))
    assert updater.fetch_from("http://x")("day/state.txt") is None
    monkeypatch.setattr(urllib.request, "urlopen", fail(500))
    with pytest.raises(urllib.error.HTTPError):
        updater.fetch_from("http://x")("day/state.txt")


def test_programs():
    from terrane.__main__ import arguments

    a = arguments(["serve", "/s", "--load", "a.pbf", "--keys", "highway", "name"])
    assert (a.program, a.store, a.load, a.keys) == ("serve", "/s", "a.pbf", ["highway", "name"])
    assert arguments(["update", "/s", "http://x", "--turns", "2"]).turns == 2
    with pytest.raises(SystemExit):
        arguments(["convert", "a.pbf"])


def test_server(spark, data, tmp_path):
    path = str(tmp_path / "store")
    store.save(data, path)
    server = serve(spark, path, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}/"
    name = ",".join(map(str, BOX))
    try:
        body = urllib.request.urlopen(at + name + ".txt").read().decode()
        assert "W 10 highway=a;" in body and "R 22 " in body
        assert urllib.request.urlopen(urllib.request.Request(at + name + ".pbf", method="HEAD")).status == 200
        for bad in ("1,2,3,4", "1,2,3.pbf", "5,5,4,4.pbf"):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(at + bad)
            assert e.value.code == 400
    finally:
        server.shutdown()

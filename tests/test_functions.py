from pyspark.sql import functions as F

from terrane.functions import coding, tags, text, tiles
from terrane.model import TAGS


def one(spark, column, rows="id bigint", data=((1,),)):
    return [r[0] for r in spark.createDataFrame(list(data), rows).select(column).collect()]


def test_tags(spark):
    df = spark.createDataFrame([(1, [("key", "value"), ("Foo", "no"), ("foo", "true"), ("n", "0")]), (2, []), (3, None)], f"id bigint, tags {TAGS}")
    t = F.col("tags")
    row = df.select(tags.get_tag(t, "key"), tags.has_tag(t, "foo"), tags.has_tag(t, "foo", "true"), tags.has_tag(t, "key", "x"), tags.tag_is_true(t, "foo"), tags.tag_is_false(t, "Foo"), tags.tag_is_false(t, "n"), tags.has_no_tags(t)).collect()
    assert tuple(row[0]) == ("value", True, True, False, True, True, True, False)
    assert tuple(row[1]) == tuple(row[2]) == (None, False, False, False, False, False, False, True)
    changed = df.select(text.tags_text(tags.add_or_replace_tag(t, "FOO", "x")), text.tags_text(tags.add_tag(t, "a", "b"))).collect()
    assert [tuple(r) for r in changed] == [("key=value;Foo=x;foo=true;n=0;", "key=value;Foo=no;foo=true;n=0;a=b;"), ("FOO=x;", "a=b;"), ("FOO=x;", "a=b;")]
    equal = df.select(tags.tags_equal(t, tags.no_tags())).collect()
    assert [r[0] for r in equal] == [False, True, True]


def test_parse_tags(spark):
    got = one(spark, text.tags_text(tags.parse_tags(F.col("s"))), "s string", [("foo=true;bar=false",), ("a=b=c;d;;",), ("",)])
    assert got == ["foo=true;bar=false;", "a=b=c;d=;", "=;"]


def test_fixed_point(spark):
    got = spark.createDataFrame([(47.1, -122.2), (-45.5, 122.2)], "lat double, lon double").select(tiles.fixed(F.col("lat")), tiles.fixed(F.col("lon"))).collect()
    assert [tuple(r) for r in got] == [(471000000, -1222000000), (-455000000, 1222000000)]


def test_tiles(spark):
    assert tiles.tile_of(45.0, -122.0) == (659, 1473)
    lat, lon = F.lit(45.0), F.lit(-122.0)
    assert one(spark, F.struct(tiles.x_tile(lon), tiles.y_tile(lat)))[0] == (659, 1473)
    x0, y0, x1, y1 = tiles.tile_range(45.2, -122.8, 45.4, -122.6)
    assert x0 <= x1 and y0 <= y1
    assert tiles.tile_range(-90, -180, 90, 180)[1] == 0
    for bad in ("1,2,3", "5,5,4,6", "0,0,91,1", "a,b,c,d"):
        try:
            tiles.parse_box(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    assert tiles.parse_box("45.2;-122.8;45.4;-122.6") == (45.2, -122.8, 45.4, -122.6)


def test_texts(spark):
    assert one(spark, text.speed_text(F.lit(12.25))) == ["12.3 kph"]
    assert one(spark, text.sequence_path(F.lit(4212345))) == ["004/212/345"]
    assert one(spark, text.state_epoch(F.lit("2020-09-13T12\\:26\\:40Z"))) == [1600000000]
    assert one(spark, text.epoch_text(F.lit(1600000000000))) == ["2020-09-13 12:26:40"]
    assert one(spark, text.human_count(F.col("id")), "id bigint", [(7,), (1000,), (1500,), (2500000,)]) == ["7", "1000", "1k", "2.5M"]
    assert [t.lower() for t in text.Timescale] == ["day", "hour", "minute"]


def test_zigzag(spark):
    data = [(0,), (-1,), (1,), (2**40,), (-(2**40),), (2**62,)]
    assert one(spark, coding.unzigzag(coding.zigzag(F.col("id"))), "id bigint", data) == [d[0] for d in data]
    assert one(spark, coding.zigzag(F.col("id")), "id bigint", data[:3]) == [0, 1, 2]

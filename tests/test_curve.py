import random

import pytest
from pyspark.sql import functions as F

from terrane.operators import curve


def plain_key(x, y):
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(31))


def test_keys(spark):
    r = random.Random(1)
    points = [(0, 0), (2**31 - 1, 2**31 - 1), (5, 9)] + [(r.randrange(2**31), r.randrange(2**31)) for _ in range(200)]
    rows = spark.createDataFrame(points, "x int, y int").withColumn("k", curve.key(F.col("x"), F.col("y")))
    for x, y, k, bx, by in rows.select("*", curve.x_of(F.col("k")), curve.y_of(F.col("k"))).collect():
        assert k == plain_key(x, y) and (bx, by) == (x, y)


def test_intervals_hold_the_box_and_nothing_else():
    r = random.Random(2)
    for _ in range(60):
        x0, y0 = r.randrange(32), r.randrange(32)
        x1, y1 = r.randrange(x0, 32), r.randrange(y0, 32)
        box = {plain_key(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
        found = curve.intervals(x0, y0, x1, y1, 5, most=1000)
        assert {k for a, b in found for k in range(a, b + 1)} == box and all(a[1] + 1 < b[0] for a, b in zip(found, found[1:]))
        few = curve.intervals(x0, y0, x1, y1, 5, most=3)
        assert len(few) <= 3 and box <= {k for a, b in few for k in range(a, b + 1)}
    assert curve.intervals(0, 0, 4095, 4095, 12) == [(0, 4**12 - 1)]


def test_a_stored_index_reads_few_rows(spark, tmp_path):
    rows = spark.range(40_000).select((F.col("id") % 200).cast("int").alias("xtile"), (F.col("id") / 200).cast("int").alias("ytile"), F.col("id").alias("way_id"))
    path = str(tmp_path / "index")
    curve.write_index(rows, path, files=32)
    found = curve.read_index(spark, path, 10, 20, 17, 27)
    assert sorted(map(tuple, found.collect())) == sorted((x, y, y * 200 + x) for x in range(10, 18) for y in range(20, 28))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "Or(" in plan or "GreaterThanOrEqual(key" in plan
    # Files whose keys meet no interval: a reader needs their footers only.
    spans = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("key"), F.max("key")).collect()
    asked = curve.intervals(10, 20, 17, 27, 12)
    assert len(spans) == 32 and sum(any(a <= s[2] and b >= s[1] for a, b in asked) for s in spans) <= 4
    with pytest.raises(ValueError):
        curve.read_index(spark, path, 5, 5, 4, 4)


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_pyramid(spark, most):
    r = random.Random(3)
    points = [(r.choice([3, r.randrange(16)]), r.choice([3, r.randrange(16)])) for _ in range(300)]
    keys = spark.createDataFrame(points, "x int, y int").select(curve.key(F.col("x"), F.col("y")).alias("key"))

    def split(z, x, y):
        side = 1 << (4 - z)
        n = sum(x * side <= a < (x + 1) * side and y * side <= b < (y + 1) * side for a, b in points)
        if not n:
            return []
        return [(z, x, y, n)] if n <= most or z == 4 else [t for i in (0, 1) for j in (0, 1) for t in split(z + 1, 2 * x + i, 2 * y + j)]

    assert sorted(map(tuple, curve.pyramid(keys, 4, most).collect())) == sorted(split(0, 0, 0))

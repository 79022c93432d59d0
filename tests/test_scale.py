"""What a task holds does not grow with the tables."""

import os

import pytest
from pyspark.sql import functions as F

from terrane.operators import analyze
from terrane.plans import catalogue, fixtures

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
def test_views_are_dealt_in_proportion_to_the_tables(spark, monkeypatch):
    assert fixtures.pieces(spark, DIR) == 4
    whole = {name: fixtures.view(spark, DIR, name) for name in ("way_refs", "nodes")}
    monkeypatch.setattr(fixtures, "PIECE", 1 << 13)
    assert fixtures.pieces(spark, DIR) > 20
    for name, before in whole.items():
        dealt = fixtures.view(spark, DIR, name)
        assert dealt.exceptAll(before).count() == before.exceptAll(dealt).count() == 0
        shares = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert len(shares) > 20 and max(shares) < sum(shares) / 10


def test_bitmaps_of_sparse_sets_are_small(spark):
    """Ids far apart: a row of two numbers for each, where a bitmap of a large bucket takes 4 KB."""
    ids = spark.range(1000).select((F.col("id") * 100_000 - 5_000_000).alias("id"))
    found = analyze.id_bitmaps(ids.unionByName(ids), "id")
    assert found.count() == 1000 and dict(found.dtypes)["bits"] == "bigint"
    assert analyze.cardinality(ids.unionByName(ids), "id").first()["n"] == 1000
    asked = ids.unionByName(ids.select((F.col("id") + 63).alias("id"))).unionByName(spark.createDataFrame([(None,), (-1,)], "id bigint"))
    marked = analyze.IdSet(ids, "id").mark(asked, "id", "inside")
    assert marked.where("inside").select("id").exceptAll(ids).count() == 0 and marked.where("inside").count() == 1000 and marked.count() == 2002


def test_sequence_paths_over_nine_digits(spark):
    """As the reference writes them: no digit is cut off, so no two sequences have one path."""
    from terrane.functions import text
    from terrane.streaming.updater import path_of

    some = [0, 999, 1000, 999_999_999, 1_000_000_696, 1_112_999_999]
    got = spark.createDataFrame([(n,) for n in some], "n bigint").select(text.sequence_path(F.col("n"))).collect()
    assert [r[0] for r in got] == [path_of(n) for n in some] and got[4][0] == "1000/000/696"
    assert "sequence_path" in catalogue.QUERIES


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
def test_changes_come_in_three_batches_of_files_that_follow_the_tables(spark, monkeypatch):
    from terrane.plans import kept_current
    from terrane.sources import folders

    at, shared = {}, folders.shared
    monkeypatch.setattr(folders, "shared", lambda s, name: at.setdefault(name, shared(s, name)))
    monkeypatch.setattr(fixtures, "PIECE", 1 << 11)
    kept_current.keyed_changes(spark, DIR)
    files = [n for n in folders.names(spark, at["changes"]) if n.endswith(".parquet")]
    assert 10 <= len(files) <= 3 * (folders.size(spark, f"{DIR}/events.parquet") // (3 << 11) + 1)
    assert [n for n in folders.names(spark, at["state"] + "/commits") if n.isdigit()] == ["0", "1", "2"]

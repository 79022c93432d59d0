"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from terrane.plans import catalogue

DIR = "/root/testdata/sf0.001"


def frame_of(rows, columns):
    return sorted(str([r[c] if not isinstance(r[c], float) else round(r[c], 9) for c in columns]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = c.execute(catalogue.ORACLES[name]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in catalogue.QUERIES[name](spark, DIR).collect()]
    columns = sorted(got[0] if got else want[0] if want else [])
    assert frame_of(got, columns) == frame_of(want, columns)


def test_contract(spark):
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES) <= set(entry.queries())
    assert entry.entry(spark).count() == 564

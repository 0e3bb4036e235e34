import os

import pytest

import __spark_entry__ as e

SMALL = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["page_stats", "core_extent_sweep", "header_footer_main", "ink_runs", "otsu", "skew_wmedian"])
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("lineitem", "documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = e.queries()[name](spark, SMALL)
    want = c.execute(e.oracle_sql()[name])
    cols = [x[0] for x in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(want.fetchall(), key=str)

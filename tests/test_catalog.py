"""Every query with an SQL oracle against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from millrace import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLES:
        assert list(got.columns)
        return
    want = duck.execute(catalog.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    a, b = (d[cols].astype(object).where(d[cols].notna(), None).sort_values(cols, key=lambda c: c.map(repr), ignore_index=True) for d in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-7, atol=1e-9)

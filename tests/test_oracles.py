"""Every registered query on the smallest tables, held against its SQL."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from vanewright.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(frame):
    """Rows as sorted text, columns by name."""
    frame = frame[sorted(frame.columns)]
    cell = lambda v: "null" if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else f"{float(v):.9g}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(cell, row)) for row in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    got, want = registry.queries()[name](spark, DATA).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", ["l1_anomaly_features", "l2_reference_sample", "g3_kmeans_regimes"])
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0

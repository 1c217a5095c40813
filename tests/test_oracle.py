"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from threadloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and v != v) else str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v))
        elif df[c].dtype == bool or str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype(str)
        else:
            df[c] = pd.to_numeric(df[c]).astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, sf, con, name):
    got, want = plain(catalog.QUERIES[name](spark, sf).toPandas()), plain(con.sql(catalog.ORACLE[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6, rtol=0)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.exists(os.path.join(os.path.dirname(__spark_entry__.__file__), "bench.py"))

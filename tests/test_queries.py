"""Every registered query with SQL against DuckDB, at the smallest size."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from cindertally.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (list, np.ndarray)):
        return [plain(x) for x in v]
    return repr(float(v) + 0.0) if isinstance(v, (float, np.floating)) else str(v)


def values(df):
    df = df[sorted(df.columns)]
    return sorted([tuple(map(plain, r)) for r in df.itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every registered query with SQL agrees with it on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from corvane import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def one(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(one, x)) + "]"
    if x is None or pd.isna(x):
        return "null"
    if isinstance(x, (float, np.floating)):
        return f"{x:.7g}"
    return f"{float(x):.7g}" if isinstance(x, (int, np.integer)) and not isinstance(x, bool) else str(x)


def rows(df):
    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_agrees_with_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.exists("/root/testdata/sf0.001")

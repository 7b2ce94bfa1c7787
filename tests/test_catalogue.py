"""Every registered query with SQL gives the same rows as its SQL, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from factloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (pd.Timestamp, datetime.date)):
        return str(pd.Timestamp(v))
    if isinstance(v, (int, np.integer)):
        return f"{float(v):.9g}"
    return str(v)


def rows(df):
    return sorted(map(tuple, df[sorted(df.columns)].map(cell).values.tolist()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_components_are_texts(spark, duck):
    got = catalogue.QUERIES["connected_components"](spark, SF).toPandas()
    groups = dict(zip(got["node"], got["component"], strict=True))
    texts = duck.execute("SELECT 'd_' || doc_id AS n, text FROM documents").df()
    for _, part in texts.groupby("text"):
        assert len({groups[n] for n in part["n"]}) == 1
    assert len(set(groups.values())) == texts["text"].nunique()


def test_rollup_has_all_groups(spark, duck):
    got = catalogue.QUERIES["phrase_recall"](spark, SF).toPandas()
    n = duck.execute("SELECT count(DISTINCT source) FROM documents").fetchone()[0]
    assert len(got) == n + 1 and (got["recall"] == 1).all()

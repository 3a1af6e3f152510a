"""The driver contract: entry(), queries() and oracle_sql() at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from sparkdod.plans.catalog import ORACLE, QUERIES

TABLES = ["events", "embeddings", "orders"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 31 and sum(r.outliers for r in rows) == 1563  # FIXTURES anchor (k=10, sf0.001)
    assert [f.name for f in df.schema.fields] == ["window_end", "outliers"]


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_outlier_counts"}))
def test_query_matches_oracle(spark, sf001, name):
    s = E.queries()[name](spark, sf001).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf001, t + '.parquet')}')")
    o = con.execute(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert len(s) == len(o)
    cols = sorted(s.columns)

    def norm(df):
        df = df[cols].copy()
        for c in cols:
            if df[c].dtype.kind == "f":
                df[c] = df[c].round(6)
            elif df[c].dtype.kind == "M":
                df[c] = df[c].astype("datetime64[us]")
        return sorted(map(tuple, df.astype(str).values.tolist()))
    assert norm(s) == norm(o)

"""Each query with SQL gives the rows that DuckDB gives for it, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quillgraph import etl_queries, operator_queries, queries

QUERIES = queries.QUERIES | operator_queries.QUERIES | etl_queries.QUERIES
SQL = queries.SQL | operator_queries.SQL | etl_queries.SQL

SF = "/root/testdata/sf0.001"


def rows(df, columns):
    for c in df.columns:
        if df[c].dtype.kind == "M":
            df[c] = df[c].dt.date
    return sorted(str(tuple(None if pd.isna(x) else x for x in r)) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)

"""Every registered query of the library against DuckDB, at the smallest scale."""

import duckdb
import pytest

from depinfer.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x if x is None or isinstance(x, (str, bool)) else float(x)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    names = list(rel.columns)
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in rel.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_oracle_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0

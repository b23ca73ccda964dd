"""Every registered query of the reference side against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

from docloom.plans import catalog, content, extended, joined  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in catalog.ORACLE_SQL:
        rel = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(rel.columns) == columns
        assert rows == sorted(tuple(plain(dict(zip(rel.columns, r))[c]) for c in columns) for r in rel.fetchall())
    else:
        assert rows

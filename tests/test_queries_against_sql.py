import duckdb
import pytest

from pagequarry import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = ("nation", "orders", "documents", "pages", "benchmark", "labels", "conversations", "embeddings")


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    found = Q.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in found.collect())
    result = duck.execute(Q.ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert rows == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())

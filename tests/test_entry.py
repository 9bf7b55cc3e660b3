import duckdb
import pytest

import __spark_entry__ as E
from quirelake.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    return [plain(y) for y in x] if isinstance(x, list | tuple) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = want.fetchall()
    at = [want.columns.index(c) for c in order]
    assert sorted(repr([plain(r[c]) for c in order]) for r in got.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in rows)

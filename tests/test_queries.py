"""Every query against its SQL, over whole small tables."""

import duckdb
import pytest

import __spark_entry__
from atlasweave.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(value):
    return repr(float(value)) if isinstance(value, float) else repr(list(value)) if isinstance(value, (list, tuple)) else repr(value)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sql, small, name):
    df = queries.queries()[name](spark, small)
    columns = sorted(df.columns)
    found = sql.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(plain(row[i]) for i in order) for row in found.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in df.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

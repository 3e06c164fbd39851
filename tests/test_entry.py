"""The registered queries against SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from pagelattice.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(float(v), 9) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(clean(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, small, duck, name):
    df = catalog.queries()[name](spark, small)
    got = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, map(tuple, df.collect())) == rows(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_give_rows(spark, small, name):
    """What SQL can't say: rows there are, and a second run gives the same ones."""
    df = catalog.queries()[name](spark, small)
    first = rows(df.columns, map(tuple, df.collect()))
    assert first and first == rows(df.columns, map(tuple, catalog.queries()[name](spark, small).collect()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

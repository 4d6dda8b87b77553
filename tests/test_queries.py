"""Every query that has SQL gives the same rows as DuckDB."""

import math

import duckdb
import pytest

from stratalens.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else repr(round(float(v), 5) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    own = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    q = duck.sql(ORACLES[name])
    at = [q.columns.index(c) for c in sorted(df.columns)]
    assert own == sorted(tuple(plain(r[i]) for i in at) for r in q.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "org_id", "media_type", "score"] and df.count() > 0

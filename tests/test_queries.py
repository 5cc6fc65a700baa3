"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from readloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(name, spark, sf, duck):
    df = registry.QUERIES[name](spark, sf)
    cur = duck.execute(registry.ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    want = sorted(tuple(str(dict(zip(cols, r))[c]) for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(str(r[c]) for c in sorted(cols)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(name, spark, sf):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every query of the engine's own operators with a SQL twin, held against DuckDB on the smallest tables."""

import duckdb
import pytest

from tessella.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def normal(rows):
    def cell(v):
        if isinstance(v, float):
            return ("number", round(v, 5))
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return (type(v).__name__, v or "" if isinstance(v, str) else str(v))
        return ("number", round(float(v), 5)) if isinstance(v, int) else (type(v).__name__, str(v))

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, db, tiny, name):
    df = catalogue.queries()[name](spark, tiny)
    got = db.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = got.fetchall()
    assert normal(tuple(r[c] for c in names) for r in df.collect()) == normal(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - {"train_holdout"}))
def test_runs(spark, tiny, name):
    assert catalogue.queries()[name](spark, tiny).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

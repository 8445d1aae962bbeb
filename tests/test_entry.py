"""The registered queries against DuckDB on the same tables."""

import os

import duckdb
import pytest

from spanforge.plans import queries as engine

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


def canonical(df):
    cols = sorted(df.columns)
    rows = [tuple(round(float(x), 9) if isinstance(x, float) else None if x is None else str(x) for x in r) for r in df[cols].itertuples(index=False)]
    return cols, sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    assert canonical(engine.queries()[name](spark, DIR).toPandas()) == canonical(duck.execute(engine.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(engine.queries()) - set(engine.oracle_sql())))
def test_runs(spark, name):
    assert engine.queries()[name](spark, DIR).count() > 0


def test_entry_without_optional_parts():
    import __spark_entry__ as e

    assert set(engine.queries()) <= set(e.queries())

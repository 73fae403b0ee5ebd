"""Every query of the audit engine against its SQL, on the whole smallest tables."""

import glob
import os

import duckdb
import pytest

from corvane.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(items):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in items)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    sql = catalog.oracle_sql()[name]
    assert rows(df.select(*cols).collect()) == rows(con.sql(f"SELECT {', '.join(cols)} FROM ({sql}) z").fetchall())


def test_queries_without_sql_have_rows(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, SF).count() > 0, name


def test_entry_and_guard():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= len(catalog.queries())

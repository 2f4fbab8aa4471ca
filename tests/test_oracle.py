"""Every query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from kronograph import plans


def rows(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return f"{round(float(v), 6) + 0.0:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, db, sf, name):
    ours = plans.QUERIES[name](spark, sf).toPandas()
    theirs = db.sql(plans.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_llm():
    from pathlib import Path

    root = Path(plans.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "kronograph.llm" not in p.read_text(), p

"""Every query that has a SQL twin gives its rows; the others give rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from argil.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    with duckdb.connect() as c:
        for f in os.listdir(SF):
            c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
        yield c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in found)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, sql, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = df.collect()
    if name in catalogue.ORACLE_SQL:
        wanted = sql.sql(catalogue.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(wanted.columns)
        assert rows(df.columns, found) == rows(wanted.columns, wanted.fetchall())
    else:
        assert found


def test_entry(spark):
    assert entry.entry(spark).columns == ["path", "risk_score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_optional_part():
    import pathlib

    for path in pathlib.Path(catalogue.__file__).parents[1].rglob("*.py"):
        if "llm" not in path.parts:
            assert "argil.llm" not in path.read_text()

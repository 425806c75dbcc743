"""The driver contract, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import oracle_check

SRC = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n in entry.oracle_sql()]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in oracle_check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SRC}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).columns


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, con, name):
    said = oracle_check.compare(spark, con, SRC, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ": ok" in said, said


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_llm():
    root = Path(entry.__file__).parent
    for p in [*root.glob("folioform/**/*.py"), *root.glob("*.py")]:
        if "llm" not in p.parts and p.name != "__spark_entry__.py":
            assert "folioform.llm" not in p.read_text(), p

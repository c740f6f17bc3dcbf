"""Every query with checking SQL gives the same rows in both engines, over whole tables."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402


def _norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.fixture(scope="module")
def checker(data_dir):
    con = duckdb.connect()
    for file in Path(data_dir).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, data_dir, checker, name):
    frame = entry.queries()[name](spark, data_dir)
    columns = sorted(frame.columns)
    mine = sorted((tuple(_norm(x) for x in row) for row in frame.select(*columns).collect()), key=str)
    result = checker.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert mine == sorted((tuple(_norm(row[i]) for i in at) for row in result.fetchall()), key=str)


def test_entry_gives_rows(spark, data_dir):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every registered query against its SQL on the small tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import compare  # noqa: E402


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, sql, sf_dir, name):
    rows = entry.queries()[name](spark, sf_dir).toPandas()
    text = entry.oracle_sql().get(name)
    if text is None:
        assert len(rows) > 0
    else:
        assert compare(rows, sql.execute(text).df()) == ""


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))

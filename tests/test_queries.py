"""Each registered query with SQL against DuckDB, over the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quillet import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="the tables aren't there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    result = duck.execute(queries.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    expected = Counter(tuple(map(plain, r)) for r in result.fetchall())
    assert Counter(tuple(plain(r[c]) for c in names) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_incremental_covers_the_table(spark):
    whole = queries.QUERIES["inverted_index"](spark, DATA)
    assert queries.SQL["incremental_index"] == queries.SQL["inverted_index"]
    got = queries.QUERIES["incremental_index"](spark, DATA)
    assert got.count() == whole.count() and got.exceptAll(whole.select(*got.columns)).count() == 0


def test_formats_are_measured(spark):
    got = queries.QUERIES["measured_formats"](spark, DATA).collect()
    assert {r.fmt for r in got} == {"parquet", "text", "json"} and sum(r.best for r in got) == 1
    assert all(r.save_ms > 0 and r.load_ms > 0 and r.size_bytes > 1000 for r in got)

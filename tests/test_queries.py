"""Queries against their SQL twins on the smallest tables, for rules that no other test holds."""

from pathlib import Path

import __spark_entry__ as entry
import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"
PREFIXES = ("txt", "res", "str03", "str1", "dat", "src", "drv06", "drv07", "drv09", "drv17", "drv10_suspect", "qry09", "qry11", "qry18", "qry20", "qry22", "ops02", "snk03", "snk06", "q12", "q14", "scr13", "scr14", "scr15", "scr16_sort_ticker", "scr18")
NAMES = [n for n in entry.queries() if n.startswith(PREFIXES) and n in entry.oracle_sql()]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(FOLDER).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return f"{value + 0.0:.8g}" if isinstance(value, float) and value == value else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_and_twin(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    order = [df.columns.index(n) for n in names]
    assert sorted(tuple(plain(r[i]) for i in order) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())

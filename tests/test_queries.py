"""Every registered query of the library against its SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

from gridloom.plans import core

SF = "/root/testdata/sf0.001"
#: Queries left out here: none.
SLOW: set[str] = set()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows):
    """Rows as sorted lists: numbers as floats to six figures (cell ids as they are), times as text."""

    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        if isinstance(x, bool | str):
            return str(x)
        if hasattr(x, "isoformat") or isinstance(x, int) and abs(x) > 1 << 53:
            return str(x)
        return f"{float(x) + 0.0:.6g}"

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(core.QUERIES.keys() - SLOW))
def test_query_matches_sql(spark, con, name):
    got = core.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = con.sql(core.ORACLES[name])
    assert sorted(found.columns) == columns
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({core.ORACLES[name]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(expected)

"""Queries against their SQL on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import pytest

from readloom import plans

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.is_dir(), reason="the given tables aren't here")


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return [plain(y) for y in x] if isinstance(x, list) else x


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    got = plans.QUERIES[name](spark, str(SMALL))
    want = tables.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(repr([plain(x) for x in r]) for r in want.fetchall())
    assert sorted(repr([plain(x) for x in r]) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == rows

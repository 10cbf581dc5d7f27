"""Every registered query against its SQL twin."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from quillon import plans


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_every_query_has_a_twin():
    assert set(plans.queries()) == set(plans.oracles())


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(name, spark, data, duck):
    df = plans.queries()[name](spark, data)
    mine = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    cur = duck.execute(plans.oracles()[name])
    columns = [c[0] for c in cur.description]
    at = [columns.index(c) for c in sorted(columns)]
    theirs = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    assert sorted(df.columns) == sorted(columns)
    assert mine and ordered(mine) == ordered(theirs)

"""Every query against its DuckDB SQL, as the driver compares them."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from barloom.plans import queries as q

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        if os.path.isfile(path):
            con.execute(f"create view {name} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_against_sql(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    got = duck.execute(q.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    want, made = rows(columns, got.fetchall()), rows(df.columns, df.collect())
    assert len(made) == len(want)
    bad = [(a, b) for a, b in zip(made, want) if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-5, rel_tol=1e-9)) for x, y in zip(a, b))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_runs(spark, name):
    q.QUERIES[name](spark, SF).collect()


def test_cross_section_is_exact(spark):
    """Signs and ties of rank correlations don't hang on the order of additions: the same at sf0.01 with 1, 4 and 8 threads."""
    sf, name = SF.replace("sf0.001", "sf0.01"), "cross_section_ic"
    df, found = q.QUERIES[name](spark, sf), []
    for threads in (1, 4, 8):
        con = duckdb.connect(config={"threads": threads})
        con.execute(f"create view events as select * from '{sf}/events.parquet'")
        got = con.execute(q.ORACLES[name])
        found.append(rows([d[0] for d in got.description], got.fetchall()))
    assert found[0] == found[1] == found[2] == rows(df.columns, df.collect())

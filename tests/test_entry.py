import datetime as dt
import decimal

import pytest

import __spark_entry__ as e
from tidewright.oracle import ORACLE_SQL
from tidewright.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_every_oracle_belongs_to_a_query():
    assert set(e.oracle_sql()) <= set(e.queries()) and set(ORACLE_SQL) <= set(QUERIES)


def test_entry_runs(spark):
    assert e.entry(spark).count() > 0


def plain(v):
    """A value in a form that both engines' results can be compared in."""
    if isinstance(v, dt.datetime):
        return str(v.date()) if v.time() == dt.time() else str(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    return float(v) if isinstance(v, (int, float, decimal.Decimal)) else str(v)


def alike(a, b):
    """Equal, or numbers that differ in their last rounded place."""
    return a == b or isinstance(a, float) and isinstance(b, float) and (abs(a - b) <= 1.1e-3 or abs(a - b) <= 1e-8 * abs(b) or a != a and b != b)


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, con, name):
    """Columns, rows and values."""
    got = QUERIES[name](spark, SMALL)
    have = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in have.description]
    assert sorted(columns) == sorted(got.columns)
    order = lambda r: ([x for x in r if isinstance(x, str)], [f"{x:.1e}" for x in r if isinstance(x, float)])
    want = sorted((tuple(map(plain, r)) for r in have.fetchall()), key=order)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=order)
    assert len(found) == len(want) and all(alike(a, b) for x, y in zip(found, want) for a, b in zip(x, y))


def test_series_carry_their_key(spark):
    """No window without a partition, no cross join in the flagship."""
    plan = QUERIES["leaderboard"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Cartesian" not in plan

"""Series of any length: blocks with halos and quantiles by refinement, against plain windows and numpy."""

import datetime as dt
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import explore, features, halo, quantiles
from tidewright.oracle import ORACLE_SQL
from tidewright.queries import QUERIES
from tidewright.series import with_position

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def long(spark):
    """One series of 900 rows bunched in time, one of 40 and one of a single row, in no order."""
    rng = np.random.default_rng(4)
    rows = [("a", START + dt.timedelta(seconds=int(k) ** 3), float(v)) for k, v in enumerate(rng.normal(50, 9, 900).round(2))]
    rows += [("b", START + dt.timedelta(hours=k), float(k % 5)) for k in range(40)] + [("c", START, 1.0)]
    rng.shuffle(rows)
    return spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "series_id string, ts timestamp_ntz, y double").persist()


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    got, want = (sorted(map(tuple, x.select(*sorted(x.columns)).collect()), key=repr) for x in (a, b))
    key = lambda r: [None if v is None else round(v, 8) if isinstance(v, float) and math.isfinite(v) else v for v in r]
    assert sorted(map(repr, map(key, got))) == sorted(map(repr, map(key, want)))


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_places(spark, long, ranges):
    same(halo.number_rows(long, ranges), with_position(long).withColumn("t", F.col("t").cast("long")))


@pytest.mark.parametrize("rows", [1, 5, 64, 10_000])
def test_rolling_in_blocks(long, rows):
    same(features.rolling(long, [7, 28], rows=rows), features.rolling(long, [7, 28]))


def test_other_windows_in_blocks(long):
    same(features.feature_frame(long, "D", rows=50), features.feature_frame(long, "D"))
    same(features.differences(long, rows=16), features.differences(long))
    same(features.rolling_band(long, rows=100), features.rolling_band(long))
    same(explore.rolling_anomalies(long, rows=33), explore.rolling_anomalies(long))


def test_means_between_two_rounded_values(spark, tmp_path):
    """Of 32 or 64 cents a mean can end in a 5 after the last place; of equal sums of seven a ratio can."""
    duckdb = pytest.importorskip("duckdb")
    for seed in range(6):
        rng = np.random.default_rng(seed)
        cents = rng.integers(0, 9000, 400) if seed % 2 else 16 * rng.integers(1, 40, 400)
        rows = [(k, START + dt.timedelta(seconds=k), float(v) / 100) for k, v in enumerate(cents)]
        at = tmp_path / f"{seed}"
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, value double").coalesce(1).write.parquet(f"{at}/events.parquet")
        con = duckdb.connect()
        con.execute(f"create view events as select * from '{at}/events.parquet/*.parquet'")
        have = con.execute(f"select * from ({ORACLE_SQL['long_features']}) order by ts")
        columns = [c[0] for c in have.description]
        assert [tuple(r) for r in QUERIES["long_features"](spark, str(at)).orderBy("ts").select(*columns).collect()] == have.fetchall()


@pytest.mark.parametrize("rows", [1, 5, 64])
def test_wide_means_with_nulls_in_blocks(spark, long, rows):
    gaps = long.withColumn("y", F.when(F.hash("ts") % 3 != 0, F.col("y")))
    same(features.rolling(gaps, [15, 16, 17, 33, 90], rows=rows), features.rolling(gaps, [15, 16, 17, 33, 90]))


def test_rows_after(long):
    made = lambda df, order: df.withColumn("next", F.sum("y").over(order.rowsBetween(0, 9)))
    same(halo.windows(long, made, 0, 9, rows=4), halo.windows(long, made, 0, 9))


def test_no_window_by_series_alone(long):
    plan = features.rolling(long, [7], rows=64)._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan and not re.search(r"hashpartitioning\(series_id#\d+, \d+\)", plan)


def test_empty_and_bounds(spark, long):
    assert features.rolling(long.limit(0), [7], rows=8).collect() == []
    with pytest.raises(ValueError):
        features.rolling(long, [7], rows=0)


VALUES = {
    "plain": np.random.default_rng(1).normal(0, 1, 3001),
    "ties": np.repeat([1.0, 2.0, 5.0], [700, 3, 300]),
    "wide": np.r_[10.0 ** np.arange(-300, 300), -(10.0 ** np.arange(-300, 300)), 0.0, -0.0],
    "ends": np.array([-np.inf, -1.7e308, 5e-324, 1.7e308, np.inf]),
    "one": np.array([3.5]),
    "near": 1e15 + np.arange(500) * 0.125,
}


@pytest.mark.parametrize("bins,most", [(256, 50_000), (8, 0)])
def test_quantiles(spark, bins, most, monkeypatch):
    monkeypatch.setattr(quantiles, "MOST_BROADCAST", most)
    monkeypatch.setattr(quantiles, "SALTS", 3)
    names = [k for k in VALUES if bins > 8 or k != "wide"]
    rows = [(k, float(v)) for k in names for v in VALUES[k]] + [("plain", None), ("none", None), ("plain", float("nan"))]
    ps = (0.0, 0.25, 0.5, 0.501, 1.0)
    out = {r["series_id"]: r for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "series_id string, y double"), ps, bins=bins).collect()}
    assert set(out) == set(names)
    for k in names:
        v = np.sort(VALUES[k])
        assert out[k]["n"] == len(v)
        for p, q in zip(ps, out[k]["q"]):
            at = (len(v) - 1) * p
            a, b = v[math.floor(at)], v[math.ceil(at)]
            assert q == a if a == b else q == pytest.approx(a + (b - a) * (at - math.floor(at)), rel=1e-12)


def test_quantile_arguments(spark):
    df = spark.createDataFrame([("a", 1.0)], "series_id string, y double")
    for bad in ((), (1.5,)):
        with pytest.raises(ValueError):
            quantiles.exact_quantiles(df, bad)
    assert quantiles.exact_quantiles(df.limit(0), [0.5]).collect() == []


def test_bounded_operators_agree(long):
    same(explore.summary_stats(long, bounded=True), explore.summary_stats(long))
    same(explore.iqr_anomalies(long, 1.0, bounded=True), explore.iqr_anomalies(long, 1.0))

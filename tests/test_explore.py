import numpy as np

from helpers import dates, linear, rows, series
from tidewright.operators import explore


def test_trend_directions(spark):
    up = rows(explore.trend(series(spark, linear(100, 0.5))))[0]
    down = rows(explore.trend(series(spark, linear(100, -0.5))))[0]
    flat = rows(explore.trend(series(spark, np.random.default_rng(0).normal(100, 5, 100))))[0]
    assert (up["direction"], down["direction"], flat["direction"]) == ("increasing", "decreasing", "stable")
    assert abs(up["slope"] - np.polyfit(range(100), linear(100, 0.5), 1)[0]) < 1e-5


def test_trend_of_a_perfect_line_and_of_two_points(spark):
    r = rows(explore.trend(series(spark, range(50))))[0]
    assert r["p_value"] == 1.0 and r["direction"] == "stable"
    assert rows(explore.trend(series(spark, [1, 2])))[0]["p_value"] == 1.0


def test_decomposition_invariants(spark):
    y = linear(120, season=20)
    for period in (7, 12):
        out = rows(explore.decompose(series(spark, y), period), "t")
        assert all(abs(r["trend"] + r["seasonal"] + r["resid"] - r["y"]) < 1e-9 for r in out)
        assert abs(sum(r["seasonal"] for r in out[:period])) < 1e-8
    assert explore.decompose(series(spark, y[:13]), 7).isEmpty()


def test_even_period_window(spark):
    y = np.arange(40.0) ** 1.5
    out = rows(explore.decompose(series(spark, y), 4), "t")
    want = (0.5 * y[8] + y[9] + y[10] + y[11] + 0.5 * y[12]) / 4
    assert abs(out[10]["trend"] - want) < 1e-9


def test_seasonality_found_and_not_found(spark):
    weekly = rows(explore.detect_seasonality(series(spark, linear(200, season=30)), "D"))[0]
    assert weekly["detected"] and weekly["period"] == 7 and weekly["periods"]["weekly"]["strength"] > 0.9 and weekly["note"] is None
    none = rows(explore.detect_seasonality(series(spark, linear(20)), "D"))[0]
    assert not none["detected"] and none["period"] is None
    assert not rows(explore.detect_seasonality(series(spark, linear(50)), "YS"))[0]["detected"]
    assert rows(explore.detect_periodicity(series(spark, linear(200, season=30)), "D"))[0]["primary"] == "weekly"


def test_volatility_levels(spark):
    rng = np.random.default_rng(2)
    y = np.r_[rng.normal(0, 1, 60), rng.normal(0, 6, 60)]
    both = series(spark, y).unionByName(series(spark, range(10), "b"))
    out = {r["series_id"]: r for r in rows(explore.volatility(both))}
    assert out["a"]["level"] == "increasing" and out["b"]["level"] == "unknown"
    w = max(7, min(28, 120 // 5))
    assert abs(out["a"]["recent"] - y[-w:].std(ddof=1)) < 1e-3


def test_anomalies(spark):
    y = linear(100)
    y[40] = 900
    out = rows(explore.iqr_anomalies(series(spark, y)), "ts")
    assert [k for k, r in enumerate(out) if r["is_anomaly"]] == [40]
    roll = rows(explore.detect_anomalies(series(spark, y), "rolling"), "ts")
    assert roll[40]["is_anomaly"]
    digest = rows(explore.anomaly_digest(explore.iqr_anomalies(series(spark, y))))[0]
    assert digest["count"] == 1 and digest["dates"] == [dates(100)[40]]
    assert not any(r["is_anomaly"] for r in rows(explore.iqr_anomalies(series(spark, [1.0] * 20))))


def test_histogram_counts_all(spark):
    out = rows(explore.histogram(series(spark, linear(300))))
    assert sum(r["n"] for r in out) == 300 and max(r["bin"] for r in out) == 39


def test_whole_exploration(spark):
    r = rows(explore.explore(spark, series(spark, linear(200, season=30)), "D"))[0]
    assert r["seasonality"]["period"] == 7 and r["decomposition"]["resid_std"] > 0 and r["anomalies"]["count"] == 0

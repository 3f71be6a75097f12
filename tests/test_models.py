import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import dates, linear, rows, series
from tidewright.errors import UnknownModel
from tidewright.operators import backtest as bt
from tidewright.operators import fitting, smoothing


def demand(n=200):
    t = np.arange(n)
    return 100 + 0.5 * t + 20 * np.sin(2 * np.pi * t / 7) + np.random.default_rng(42).normal(0, 4, n)


def ahead(spark, y, model, h=14, **context):
    s = series(spark, y)
    plan = bt.final_fold(s, h)
    if model == "naive":
        return rows(bt.naive_forecasts(s, plan), "h")
    if model == "seasonal_naive":
        return rows(bt.seasonal_naive_forecasts(s, plan), "h")
    plan = plan.withColumn("periods", F.array(F.lit(7)))
    return rows(bt.model_forecasts(s, plan, [model], 60), "h")


@pytest.mark.parametrize("model", ["naive", "seasonal_naive", "ets", "arima", "xgboost"])
def test_shape_and_bands(spark, model):
    out = ahead(spark, demand(), model)
    assert len(out) == 14 and [r["h"] for r in out] == list(range(1, 15))
    assert all(np.isfinite(r["yhat"]) and r["lower"] <= r["yhat"] <= r["upper"] for r in out)
    assert out[-1]["upper"] - out[-1]["lower"] >= out[0]["upper"] - out[0]["lower"]


def test_naive_values(spark):
    y = demand()
    assert all(r["yhat"] == y[-1] for r in ahead(spark, y, "naive"))
    s = ahead(spark, y, "seasonal_naive")
    assert s[0]["yhat"] == y[-7] and s[6]["yhat"] == y[-1] and s[7]["yhat"] == y[-7]
    assert ahead(spark, [1.0, 2.0, 3.0], "seasonal_naive", 2)[1]["yhat"] == 3.0


def test_band_of_a_pure_season_is_zero(spark):
    out = ahead(spark, list(range(7)) * 20, "seasonal_naive")
    assert all(r["lower"] == r["upper"] for r in out)


def test_seasonal_models_beat_naive():
    y = demand(400)
    train, test = y[:386], y[386:]
    off = lambda f: np.abs(f - test).mean()
    naive = off(np.full(14, train[-1]))
    days = np.array(dates(386), "datetime64[D]").astype("datetime64[ns]")
    assert off(fitting.fit_arima(train, 14, "D")[0]) < 0.7 * naive
    assert off(fitting.fit_trees(train, days, 14, "D", 150)[0]) < 0.7 * naive


def plain_smoothing(y, p, a, b, g):
    """The recursion in Python: forecasts' level, slope and season, and the one-step errors."""
    if p:
        first, second = np.mean(y[:p]), np.mean(y[p : 2 * p])
        level, slope, season = first, (second - first) / p, [v - first for v in y[:p]]
    else:
        level, slope, season = y[0], (y[1] - y[0] if len(y) > 1 else 0.0), [0.0]
    errors = []
    for v in y:
        s = season.pop(0)
        e = v - level - slope - s
        level, slope = level + slope + a * e, slope + a * b * e
        season.append(s + g * e)
        errors.append(e)
    return level, slope, season, np.array(errors)


@pytest.mark.parametrize("n,periods,p", [(200, [7], 7), (200, [30, 7], 7), (95, [30], 30), (20, [7], 0), (60, [], 0), (60, [9], 7), (1, [], 0)])
def test_smoothing_is_the_recursion_with_good_weights(spark, n, periods, p):
    y = demand(max(n, 2))[:n]
    s = series(spark, y)
    out = rows(smoothing.ets_forecasts(s, bt.final_fold(s, 9).withColumn("periods", F.array(*map(F.lit, periods)).cast("array<int>"))), "h")
    meta = json.loads(out[0]["meta"])
    assert meta.get("seasonal_period", 0) == p and meta["method"] == ("ets" if p else "ets_simple")
    level, slope, season, errors = plain_smoothing(y, p, meta["alpha"], meta["beta"], meta["gamma"])
    want = [level + slope * h + season[(h - 1) % len(season)] for h in range(1, 10)]
    assert np.allclose([r["yhat"] for r in out], want) and np.allclose([r["upper"] - r["yhat"] for r in out], 1.96 * errors.std() * np.sqrt(np.arange(1, 10)))
    rng = np.random.default_rng(3)
    tried = [plain_smoothing(y, p, *w)[3] for w in rng.uniform(0.01, 0.99, (60, 3)) * (1, 1, 1 if p else 0)]
    assert errors @ errors <= min(e @ e for e in tried) * 1.02


def test_smoothing_beats_naive(spark):
    y = demand(400)
    s = series(spark, y[:386])
    out = rows(smoothing.ets_forecasts(s, bt.final_fold(s, 14).withColumn("periods", F.array(F.lit(7)))), "h")
    assert np.abs([r["yhat"] for r in out] - y[386:]).mean() < 0.5 * np.abs(y[385] - y[386:]).mean()


def test_holt_recursion_matches_sql(spark):
    y = demand(60)
    r = rows(bt.holt_winters_fixed(series(spark, y), 0.3, 0.1))[0]
    level, slope = y[0], 0.0
    for v in y[1:]:
        new = 0.3 * v + 0.7 * (level + slope)
        slope = 0.1 * (new - level) + 0.9 * slope
        level = new
    assert abs(r["level"] - level) < 1e-9 and abs(r["slope"] - slope) < 1e-9


def test_arima_recovers_an_autoregression():
    rng = np.random.default_rng(5)
    y = np.zeros(800)
    for t in range(1, 800):
        y[t] = 0.7 * y[t - 1] + rng.normal()
    m = fitting.fit_order(y + 10, (1, 0, 0))
    assert abs(-m["ar"][1] - 0.7) < 0.06 and abs(m["var"] - 1) < 0.12
    walk = fitting.fit_arima(np.cumsum(rng.normal(size=27)), 3, "IR")
    assert len(walk[0]) == 3 and walk[3]["label"].startswith("ARIMA")


def test_importances_are_sorted(spark):
    days = np.array(dates(200), "datetime64[D]").astype("datetime64[ns]")
    imp = [v for _, v in fitting.fit_trees(demand(), days, 1, "D", 40)[3]["importance"]]
    assert imp == sorted(imp, reverse=True) and abs(sum(imp) - 1) < 1e-9


def test_trees_do_not_see_the_target():
    y = np.random.default_rng(0).normal(100, 10, 300)
    days = np.array(dates(300), "datetime64[D]").astype("datetime64[ns]")
    honest = fitting.fit_trees(y, days, 1, "D", 80)[3]
    leaky = fitting.fit_trees(y, days, 1, "D", 80, compat=True)[3]
    assert leaky["residual_std"] < honest["residual_std"]


def test_fold_plan_equals_the_rule(spark):
    for n, freq, folds, horizon in ((1095, "D", 4, None), (150, "D", 4, None), (100, "W", 3, None), (60, "MS", 4, 5), (45, "IR", 5, None)):
        s = series(spark, range(n)).withColumn("frequency", F.lit(freq))
        got = [(r["train_end"], r["size"]) for r in rows(bt.plan_folds(s, folds, 0.6, horizon), "fold")]
        start, left, want = max(30, int(n * 0.6)), n - max(30, int(n * 0.6)), []
        for i in range(folds):
            size = min(max(7, min(horizon, left) if horizon else min(bt.size_guess(left, folds - i, freq), left)), left)
            if size:
                want.append((start, size))
            start, left = start + size, left - size
        assert got == want
    assert got and bt.plan_folds(series(spark, range(30)).withColumn("frequency", F.lit("D"))).isEmpty()


def test_published_fold_sizes(spark):
    plan = rows(bt.plan_folds(series(spark, range(1095)).withColumn("frequency", F.lit("D"))), "fold")
    assert [r["train_end"] for r in plan][0] == 657 and [r["size"] for r in plan] == [109, 109, 110, 110]


def test_ranking_and_custom_models(spark):
    good = bt.Model("median_model", lambda y, d, h, c: (np.full(h, np.median(y[-30:])),) * 3 + ({},))
    bad = bt.Model("triple_min", lambda y, d, h, c: (np.full(h, 3 * y.min()),) * 3 + ({},))
    broken = bt.Model("broken", lambda y, d, h, c: 1 / 0)
    out = bt.backtest(series(spark, linear(150)), models=["naive", good, bad, broken])
    board = {r["model"]: r for r in rows(out["leaderboard"])}
    assert board["median_model"]["rank"] < board["triple_min"]["rank"] and "broken" not in board
    assert sum(r["is_best"] for r in board.values()) == 1 and board["naive"]["n_folds_valid"] == 4
    errors = rows(out["forecasts"].where("model = 'broken'"))
    assert errors and all("division" in r["error"] for r in errors)
    with pytest.raises(UnknownModel):
        bt.backtest(series(spark, linear(150)), models=["nothing"])


def test_ties_keep_catalogue_order(spark):
    scores = spark.createDataFrame([("a", m, 1, 1.0, 1.0, 1.0, 1.0, 1.0, 7) for m in ("seasonal_naive", "naive")], "series_id string, model string, fold int, mae double, rmse double, mape double, smape double, wape double, n long")
    assert [r["model"] for r in rows(bt.leaderboard(scores), "rank")] == ["naive", "seasonal_naive"]

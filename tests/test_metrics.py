import numpy as np
import pytest

from helpers import rows
from tidewright.errors import ValidationError
from tidewright.operators import intervals, metrics


def scored(spark, a, f):
    df = spark.createDataFrame([("a", k, float(x), float(y)) for k, (x, y) in enumerate(zip(a, f))], "series_id string, h int, y double, yhat double")
    return rows(metrics.compute_metrics(df, "series_id"))[0]


def test_formulas(spark):
    assert scored(spark, [1, 2, 3], [2, 2, 2])["mae"] == 0.6667
    assert scored(spark, [0, 0, 0], [3, 4, 0])["rmse"] == round((25 / 3) ** 0.5, 4)
    r = scored(spark, [100, 200], [110, 180])
    assert r["mape"] == 10 and r["wape"] == 10 and r["n"] == 2
    z = scored(spark, [0, 10], [1, 9])
    assert z["mape"] is None and len(z["notes"]) == 1
    both = scored(spark, [0, 0], [0, 0])
    assert both["smape"] is None and both["wape"] == 0


def test_align_refuses_unequal_lengths(spark):
    a = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0)], "series_id string, h int, y double")
    f = spark.createDataFrame([("a", 1, 1.0)], "series_id string, h int, yhat double")
    with pytest.raises(ValidationError):
        metrics.align(a, f, "series_id", "h")
    assert metrics.align(a.where("h = 1"), f, "series_id", "h").count() == 1


def test_scaled_error(spark):
    df = spark.createDataFrame([("a", k, y, 2.0) for k, y in enumerate([1.0, 2.0, 4.0])] + [("b", k, 5.0, 4.0) for k in range(3)], "series_id string, h int, y double, yhat double")
    out = {r["series_id"]: r["mase"] for r in rows(metrics.scaled_error(df, "series_id"))}
    assert out["a"] == round((1 + 0 + 2) / 3 / 1.5, 4) and out["b"] is None


def diagnosed(spark, values):
    return rows(metrics.residual_diagnostics(spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(values)], "series_id string, t int, r double")))[0]


def test_diagnostics_tell_noise_from_walk(spark):
    e = np.random.default_rng(1).normal(size=500)
    noise, walk = diagnosed(spark, e), diagnosed(spark, e.cumsum())
    assert noise["white_noise"] and not walk["white_noise"] and walk["durbin_watson"] < 0.2 and abs(noise["durbin_watson"] - 2) < 0.2
    few = diagnosed(spark, [1, 2, 3])
    assert few["mean"] is None and few["note"]


def test_bands(spark):
    df = spark.createDataFrame([("a", h, 1.0, 5.0) for h in range(1, 11)], "series_id string, h int, yhat double, sigma double")
    out = rows(intervals.gaussian_band(df), "h")
    widths = [r["upper"] - r["lower"] for r in out]
    assert widths == sorted(widths) and abs(widths[0] - 2 * 1.96 * 5) < 1e-9
    told = rows(intervals.annotate(intervals.gaussian_band(df)))[0]
    assert told["widening"] == round(10**0.5, 4)
    assert intervals.z_of(0.5) == 1.96


def test_empirical_band(spark):
    rng = np.random.default_rng(3)
    fc = spark.createDataFrame([("a", h, 0.0) for h in range(1, 8)] + [("b", 1, 0.0)], "series_id string, h int, yhat double")
    resid = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(rng.normal(0, 6, 200))] + [("b", k, 1.0) for k in range(3)], "series_id string, t int, r double")
    out = rows(intervals.empirical_band(fc, resid), "series_id", "h")
    assert all(r["lower"] < -8 and r["upper"] > 8 for r in out[:7])
    assert out[7]["method"] == "gaussian" and out[0]["method"] == "empirical"
    assert rows(intervals.empirical_band(fc, resid), "series_id", "h") == out


@pytest.mark.parametrize("path,last,want", [([110, 115, 120], 100, (20, 20, "increase")), ([90, 80], 100, (-20, -20, "decrease")), ([5], 0, (5, None, "increase"))])
def test_expected_change(spark, path, last, want):
    fc = spark.createDataFrame([("a", h + 1, float(v)) for h, v in enumerate(path)], "series_id string, h int, yhat double")
    r = rows(intervals.expected_change(fc, spark.createDataFrame([("a", float(last))], "series_id string, last_y double")))[0]
    assert (r["absolute"], r["percent"], r["direction"]) == want

import datetime as dt

import numpy as np
import pytest

from helpers import dates, linear, rows, series
from tidewright.functions.calendar import calendar_features, default_lags, default_windows, future_dates, future_features, tree_windows
from tidewright.functions.stats import chi2_sf_even, normal_cdf, t_sf_two_sided
from tidewright.operators import features


def frame(spark, values, **options):
    return rows(features.feature_frame(series(spark, values), "D", **options), "ts")


def test_lags_and_inclusive_rolling_mean(spark):
    y = linear(200)
    out = frame(spark, y)
    assert len(out) == 200
    for k in (1, 7, 28):
        assert out[100][f"lag_{k}"] == y[100 - k] and out[k - 1][f"lag_{k}"] is None
    assert abs(out[100]["rolling_mean_7"] - y[94:101].mean()) < 1e-9
    assert abs(out[100]["rolling_std_28"] - y[73:101].std(ddof=1)) < 1e-9
    assert out[5]["rolling_mean_7"] is None and out[6]["rolling_mean_7"] is not None


def test_no_look_ahead(spark):
    y = linear(120)
    changed = y.copy()
    changed[80:] += 1000
    a, b = frame(spark, y), frame(spark, changed)
    assert a[:80] == b[:80]


def test_nulls_are_carried_not_filled(spark):
    y = list(linear(60))
    y[10] = None
    out = frame(spark, y)
    assert out[11]["lag_1"] is None and out[13]["rolling_mean_28"] is None and out[14]["rolling_mean_28"] is not None


def test_momentum_carries_means_and_zero_base(spark):
    out = rows(features.add_momentum(series(spark, [0.0, 0.0, 3.0, 6.0]).withColumn("m", __import__("pyspark").sql.functions.col("y")), "m"), "ts")
    assert out[0]["momentum"] is None and out[1]["momentum"] is None and out[2]["momentum"] == float("inf") and out[3]["momentum"] == 1.0


def test_calendar_values(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30),), (dt.date(2021, 1, 1),), (dt.date(2024, 2, 29),)], "ts date")
    out = rows(calendar_features(df), "ts")
    assert (out[2]["iso_year"], out[2]["week"], out[2]["dayofweek"], out[2]["iso_weekday"]) == (2025, 1, 0, 1)
    assert out[0]["week"] == 53 and out[1]["days_in_month"] == 29 and out[1]["is_month_end"] == 1
    assert len(out[0]) == 21


def test_constants_by_frequency():
    assert default_lags("D")[-1] == 365 and default_lags("W-SUN") == default_lags("W") and default_lags("IR") == [1, 2, 3]
    assert default_windows("MS") == [3, 6, 12] and tree_windows("IR") == [7, 28] and tree_windows("D") == [7, 14, 28]


@pytest.mark.parametrize("last,freq,h,want", [("2024-03-10", "D", 3, ["2024-03-11", "2024-03-12", "2024-03-13"]), ("2024-03-06", "W", 3, ["2024-03-13", "2024-03-20", "2024-03-27"]), ("2024-03-01", "MS", 2, ["2024-04-01", "2024-05-01"]), ("2024-01-01", "QS", 2, ["2024-04-01", "2024-07-01"]), ("2024-03-10", "YS", 1, ["2025-01-01"]), ("2024-03-10", "IR", 2, ["2024-03-11", "2024-03-12"])])
def test_horizon_grid(spark, last, freq, h, want):
    grid = future_dates(spark.createDataFrame([(dt.date.fromisoformat(last), freq)], "last_ts date, frequency string"), h)
    assert [str(r["ds"]) for r in rows(grid, "h")] == want


def test_future_features(spark):
    out = rows(future_features(spark.createDataFrame([(dt.date(2024, 1, 30), "D")], "last_ts date, frequency string"), 2), "h")
    assert [r["dayofmonth"] for r in out] == [31, 1]


def test_differences_and_band(spark):
    y = linear(60)
    out = rows(features.rolling_band(features.differences(series(spark, y)), 28), "ts")
    assert out[0]["diff_1"] is None and abs(out[30]["diff_7"] - (y[30] - y[23])) < 1e-12
    assert out[26]["roll_mean"] is None and out[27]["band_low"] < out[27]["roll_mean"] < out[27]["band_high"]


def test_distributions(spark):
    import math

    from pyspark.sql import functions as F

    r = spark.range(1).select(normal_cdf(F.lit(1.96)).alias("a"), normal_cdf(F.lit(-0.5)).alias("b"), chi2_sf_even(F.lit(18.307), 10).alias("c")).first()
    assert abs(r["a"] - 0.9750021) < 2e-7 and abs(r["b"] - 0.3085375) < 2e-7 and abs(r["c"] - 0.05) < 1e-5
    assert abs(t_sf_two_sided(2.0, 10) - 0.0733880) < 1e-6 and abs(t_sf_two_sided(1.96, 1e6) - math.erfc(1.96 / math.sqrt(2))) < 1e-5
    assert np.isnan(t_sf_two_sided(float("nan"), 5))


def test_dates_helper():
    assert dates(2)[1] - dates(2)[0] == dt.timedelta(days=1)

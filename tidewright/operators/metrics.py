"""Forecast metrics and residual diagnostics as single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.stats import chi2_sf_even

METRICS = ("mae", "rmse", "mape", "smape", "wape")


def metric_columns(actual: str = "y", forecast: str = "yhat") -> dict[str, Column]:
    """Unrounded metrics.  mape is null if any actual is zero; smape skips rows where both are zero; wape of zero actuals is 0."""
    a, f = F.col(actual), F.col(forecast)
    off = F.abs(a - f)
    return {
        "mae": F.avg(off),
        "rmse": F.sqrt(F.avg(off * off)),
        "mape": F.when(F.count_if(a == 0) == 0, F.avg(F.try_divide(off, F.abs(a))) * 100),
        "smape": F.avg(F.try_divide(off, (F.abs(a) + F.abs(f)) / 2)) * 100,
        "wape": F.coalesce(F.try_divide(F.sum(off), F.sum(F.abs(a))) * 100, F.lit(0.0)),
    }


def compute_metrics(pairs: DataFrame, *keys: str, actual: str = "y", forecast: str = "yhat", digits: int = 4) -> DataFrame:
    """The five metrics and n for each key; notes say why a metric is undefined."""
    out = pairs.groupBy(*keys).agg(*[F.round(c, digits).alias(k) for k, c in metric_columns(actual, forecast).items()], F.count("*").alias("n"))
    notes = F.array_compact(F.array(F.when(F.col("mape").isNull(), F.lit("mape is undefined: an actual value is zero")), F.when(F.col("smape").isNull(), F.lit("smape is undefined: all values are zero"))))
    return out.withColumn("notes", notes)


def align(actuals: DataFrame, forecasts: DataFrame, *keys: str) -> DataFrame:
    """Actuals and forecasts joined on the keys; raises if either side has rows that the other lacks."""
    a, f, both = actuals.count(), forecasts.count(), actuals.join(forecasts, list(keys))
    if not a == f == both.count():
        raise ValidationError("actuals and forecasts differ in length")
    return both


def scaled_error(pairs: DataFrame, *keys: str, order: str = "h", actual: str = "y", forecast: str = "yhat") -> DataFrame:
    """Mean absolute error over the mean absolute step of the same window's actuals; null for a flat window."""
    w = Window.partitionBy(*keys).orderBy(order)
    own = pairs.withColumn("_step", F.abs(F.col(actual) - F.lag(actual).over(w)))
    scale = F.avg("_step")
    return own.groupBy(*keys).agg(F.round(F.when(scale > 0, F.avg(F.abs(F.col(actual) - F.col(forecast))) / scale), 4).alias("mase"))


def residual_diagnostics(residuals: DataFrame, lags: int = 10, column: str = "r", order: str = "t") -> DataFrame:
    """Per series: moments, Durbin-Watson, Ljung-Box and Jarque-Bera of its finite residuals; nulls and a note where there are too few."""
    w = Window.partitionBy("series_id").orderBy(order)
    whole = Window.partitionBy("series_id")
    fine = residuals.where(F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))).select("series_id", F.col(order).alias("t"), F.col(column).alias("r"))
    w = Window.partitionBy("series_id").orderBy("t")
    own = fine.withColumn("c", F.col("r") - F.avg("r").over(whole)).withColumn("d", F.col("r") - F.lag("r").over(w))
    own = own.withColumns({f"p{k}": F.col("c") * F.lag("c", k).over(w) for k in range(1, lags + 1)})
    s = own.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurtosis"), F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("c") * F.col("c")).alias("cc"), *[F.sum(f"p{k}").alias(f"s{k}") for k in range(1, lags + 1)])
    n = F.col("n")
    q = F.lit(0.0)
    for k in range(1, lags + 1):
        rho = F.coalesce(F.try_divide(F.col(f"s{k}"), F.col("cc")), F.lit(0.0))
        q = q + F.coalesce(F.try_divide(rho * rho, n - k), F.lit(0.0))
    s = s.withColumn("lb", n * (n + 2) * q).withColumn("jb", n / 6 * (F.pow("skew", F.lit(2)) + F.pow("kurtosis", F.lit(2)) / 4))
    s = s.withColumn("lb_p", chi2_sf_even(F.col("lb"), lags)).withColumn("jb_p", F.exp(-F.col("jb") / 2))
    enough = n >= max(lags + 2, 4)
    show = lambda c, name: F.when(enough, c).alias(name)
    r4 = lambda c: F.round(c, 4)
    return s.select("series_id", "n", show(r4("mean"), "mean"), show(r4("std"), "std"), show(r4("skew"), "skew"), show(r4("kurtosis"), "excess_kurtosis"), show(r4(F.try_divide("dd", "rr")), "durbin_watson"), show(r4("lb"), "ljung_box"), show(r4("lb_p"), "ljung_box_p"), show(F.col("lb_p") > 0.05, "white_noise"), show(r4("jb"), "jarque_bera"), show(r4("jb_p"), "jarque_bera_p"), show(F.col("jb_p") > 0.05, "normal"), F.when(~enough, F.lit("too few residuals")).alias("note"))

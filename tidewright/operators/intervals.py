"""Prediction bands, what they say, and the expected change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normal quantiles by coverage.
Z = {0.80: 1.2816, 0.90: 1.6449, 0.95: 1.96, 0.99: 2.5758}


def z_of(coverage: float) -> float:
    return Z.get(round(coverage, 2), 1.96)


def band(yhat: Column, sigma: Column, h: Column, coverage: float = 0.95) -> tuple[Column, Column]:
    half = z_of(coverage) * sigma * F.sqrt(h)
    return yhat - half, yhat + half


def gaussian_band(forecasts: DataFrame, sigma: str = "sigma", coverage: float = 0.95) -> DataFrame:
    """Adds lower and upper: z * sigma * sqrt(h) around yhat."""
    low, high = band(F.col("yhat"), F.col(sigma), F.col("h"), coverage)
    return forecasts.withColumns({"lower": low, "upper": high})


def empirical_band(forecasts: DataFrame, residuals: DataFrame, coverage: float = 0.95, n_sims: int = 1000, seed: int = 42, accumulate: bool = False, column: str = "r") -> DataFrame:
    """Adds lower and upper from residuals drawn at random for each step; below five residuals the Gaussian band.

    The draws are hashes of series, step and draw number, so they do not depend on partitioning.  Residuals of a series
    are numbered, and each draw finds its residual by an equal join on (series, number).
    """
    counted = residuals.where(F.col(column).isNotNull() & ~F.isnan(column)).select("series_id", F.col(column).alias("r"), F.expr("row_number() over (partition by series_id order by t)").alias("k"))
    sizes = counted.groupBy("series_id").agg(F.count("*").alias("m"), F.coalesce(F.stddev_pop("r"), F.lit(0.0)).alias("s"))
    draws = forecasts.join(sizes, "series_id").where("m >= 5").select("series_id", "h", "m", F.explode(F.sequence(F.lit(1), F.lit(n_sims))).alias("sim"))
    draws = draws.withColumn("k", (F.pmod(F.xxhash64("series_id", "h", "sim", F.lit(seed)), F.col("m")) + 1).cast("int"))
    drawn = draws.join(counted, ["series_id", "k"])
    if accumulate:
        drawn = drawn.withColumn("r", F.expr("sum(r) over (partition by series_id, sim order by h)"))
    tail = (1 - coverage) / 2
    q = drawn.groupBy("series_id", "h").agg(F.percentile("r", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    out = forecasts.join(q, ["series_id", "h"], "left").join(sizes, "series_id", "left")
    low, high = band(F.col("yhat"), F.coalesce("s", F.lit(0.0)), F.col("h"), coverage)
    method = F.when(F.col("q").isNull(), "gaussian").otherwise("empirical")
    return out.withColumns({"lower": F.coalesce(F.col("yhat") + F.col("q")[0], low), "upper": F.coalesce(F.col("yhat") + F.col("q")[1], high), "method": method}).drop("q", "m", "s")


def annotate(forecasts: DataFrame) -> DataFrame:
    """Per series: mean, first and last width of the band, and how much it widens."""
    width = F.col("upper") - F.col("lower")
    out = forecasts.groupBy("series_id").agg(F.avg(width).alias("m"), F.min_by(width, "h").alias("a"), F.max_by(width, "h").alias("b"))
    return out.select("series_id", F.round("m", 4).alias("mean_width"), F.round("a", 4).alias("start_width"), F.round("b", 4).alias("end_width"), F.round(F.try_divide("b", "a"), 4).alias("widening"))


def expected_change(forecasts: DataFrame, last: DataFrame) -> DataFrame:
    """Per series: the last forecast against the last value (last_y): absolute, per cent of that value, direction."""
    end = forecasts.groupBy("series_id").agg(F.max_by("yhat", "h").alias("end"))
    out = end.join(last.select("series_id", "last_y"), "series_id")
    change = F.col("end") - F.col("last_y")
    pct = F.when(F.col("last_y") != 0, F.round(change / F.col("last_y") * 100, 4))
    direction = F.when(change > 0, "increase").when(change < 0, "decrease").otherwise("flat")
    return out.select("series_id", F.round(change, 4).alias("absolute"), pct.alias("percent"), F.col("last_y").alias("reference"), direction.alias("direction"))


def horizon_ends(forecasts: DataFrame) -> DataFrame:
    """Per series: first date (ds), last value, last bounds, and how the bounds were made."""
    last = [F.max_by(c, "h").alias(name) for c, name in (("yhat", "end_value"), ("lower", "lower_end"), ("upper", "upper_end"))]
    method = F.first("method") if "method" in forecasts.columns else F.lit("gaussian")
    return forecasts.groupBy("series_id").agg(F.min_by("ds", "h").alias("start_date"), *last, method.alias("uncertainty_method"))


def horizon_means(forecasts: DataFrame) -> DataFrame:
    return forecasts.groupBy("series_id").agg(*[F.round(F.avg(c), 2).alias(f"mean_{c}") for c in ("yhat", "lower", "upper")])

"""Additive exponential smoothing as array expressions: one row a training window, no Python.

A window's values are an array, the recursion is a fold over it whose state holds level, trend, the last season and the sums of
the one-step errors, and the weights come from a grid that is refined around its best point.  All of it is one expression over
(series, fold), so any number of series and folds are fitted in one pass.  The state's season is a ring: the oldest value is used
and its successor appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import with_position

# Seasons that smoothing supports, in the order in which they are tried.
SUPPORTED = [7, 12, 30, 52, 91, 365]
# First weights of level, trend and season, and the factors of the rounds that refine them.
LEVELS, TRENDS, SEASONALS = (0.05, 0.25, 0.8), (0.005, 0.05, 0.4), (0.02, 0.15, 0.6)
FACTORS = (2.0, 1.5, 1.25, 1.1)
#: Most that a weight can be.
TOP = 0.99


def season_of(n: Column, detected: Column) -> Column:
    """The smallest supported detected season that three periods of data support, else the first such of the list; 0: none."""
    every = F.array(*map(F.lit, SUPPORTED))
    wanted = F.concat(F.array_sort(F.array_intersect(detected, every)), F.when(F.size(detected) > 0, every).otherwise(F.array().cast("array<int>")))
    return F.coalesce(F.get(F.filter(wanted, lambda p: n >= 3 * p), F.lit(0)), F.lit(0))


def _mean(values: Column, n: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n


def start(ys: Column, p: Column) -> Column:
    """The first state: of the first two seasons, or of the first two values where p is 0."""
    first = _mean(F.slice(ys, F.lit(1), p), p)
    second = _mean(F.slice(ys, p + 1, p), p)
    zero = F.lit(0.0)
    seasonal = F.struct(first.alias("level"), ((second - first) / p).alias("slope"), F.transform(F.slice(ys, F.lit(1), p), lambda y: y - first).alias("season"), zero.alias("e"), zero.alias("ee"))
    plain = F.struct(ys[0].alias("level"), F.coalesce(F.get(ys, F.lit(1)) - ys[0], zero).alias("slope"), F.array(zero).alias("season"), zero.alias("e"), zero.alias("ee"))
    return F.when(p > 0, seasonal).otherwise(plain)


def smooth(ys: Column, first: Column, a: Column, b: Column, g: Column) -> Column:
    """The state after all values with these weights."""

    def step(s: Column, y: Column) -> Column:
        season = s["season"]
        e = y - (s["level"] + s["slope"]) - season[0]
        ring = F.concat(F.slice(season, F.lit(2), F.size(season)), F.array(season[0] + g * e))
        return F.struct((s["level"] + s["slope"] + a * e).alias("level"), (s["slope"] + a * b * e).alias("slope"), ring.alias("season"), (s["e"] + e).alias("e"), (s["ee"] + e * e).alias("ee"))

    return F.aggregate(ys, first, step)


def best_weights(ys: Column, first: Column, p: Column) -> Column:
    """ee, a, b, g: of the last round's grid, the least sum of squared errors and its weights."""

    def best(levels: Column, trends: Column, seasonals: Column) -> Column:
        def score(a: Column, b: Column, g: Column) -> Column:
            return F.struct(smooth(ys, first, a, b, g)["ee"].alias("ee"), a.alias("a"), b.alias("b"), g.alias("g"))

        grid = F.flatten(F.transform(levels, lambda a: F.flatten(F.transform(trends, lambda b: F.transform(seasonals, lambda g: score(a, b, g))))))
        return F.array_min(grid)

    lits = lambda xs: F.array(*map(F.lit, xs))
    around = lambda x, f: F.array(x / f, x, F.least(x * f, F.lit(TOP)))
    none = F.array(F.lit(0.0))
    zero = best(lits(LEVELS), lits(TRENDS), F.when(p > 0, lits(SEASONALS)).otherwise(none))
    return F.aggregate(lits(FACTORS), zero, lambda w, f: best(around(w["a"], f), around(w["b"], f), F.when(p > 0, around(w["g"], f)).otherwise(none)))


def ets_forecasts(series: DataFrame, folds: DataFrame) -> DataFrame:
    """series_id, model, fold, h, yhat, lower, upper, error, meta for each window of folds (with the detected seasons in `periods`,
    if there is such a column).

    A series' values are one array in one row; a window is a part of it.  The band is 1.96 times the spread of the one-step
    errors, growing with the root of the step.
    """
    values = with_position(series).groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: x["y"]).alias("ys"))
    plan = folds if "periods" in folds.columns else folds.withColumn("periods", F.array().cast("array<int>"))
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = plan.select("series_id", "fold", "train_end", "size", "periods").join(values, "series_id").where("train_end > 0")
    own = own.withColumn("ys", F.slice("ys", F.lit(1), F.col("train_end"))).repartition(tasks, "series_id", "fold")  # windows are few and fits long
    own = own.withColumn("p", season_of(F.col("train_end"), F.col("periods"))).withColumn("first", start(F.col("ys"), F.col("p")))
    own = own.withColumn("w", best_weights(F.col("ys"), F.col("first"), F.col("p")))
    own = own.withColumn("s", smooth(F.col("ys"), F.col("first"), F.col("w")["a"], F.col("w")["b"], F.col("w")["g"])).drop("ys", "first")
    n = F.col("train_end")
    sigma = F.sqrt(F.greatest(F.col("s")["ee"] / n - (F.col("s")["e"] / n) * (F.col("s")["e"] / n), F.lit(0.0)))
    meta = F.to_json(F.struct(F.when(F.col("p") > 0, "ets").otherwise("ets_simple").alias("method"), F.when(F.col("p") > 0, F.col("p")).alias("seasonal_period"), F.lit("add").alias("trend"), F.col("w")["a"].alias("alpha"), F.col("w")["b"].alias("beta"), F.col("w")["g"].alias("gamma")))
    own = own.withColumns({"sigma": sigma, "meta": meta}).withColumn("h", F.explode(F.sequence(F.lit(1), F.col("size"))))
    season = F.get(F.col("s")["season"], F.pmod(F.col("h") - 1, F.size(F.col("s")["season"])))
    own = own.withColumn("yhat", F.col("s")["level"] + F.col("s")["slope"] * F.col("h") + season).withColumn("half", 1.96 * F.col("sigma") * F.sqrt("h"))
    return own.select("series_id", F.lit("ets").alias("model"), "fold", "h", "yhat", (F.col("yhat") - F.col("half")).alias("lower"), (F.col("yhat") + F.col("half")).alias("upper"), F.lit(None).cast("string").alias("error"), "meta")

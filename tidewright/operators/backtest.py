"""Expanding-window backtests of many series, folds and models at once."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import UnknownModel
from ..series import by_time, whole_series, with_position
from . import fitting
from .smoothing import ets_forecasts
from .explore import detect_seasonality
from .metrics import METRICS, metric_columns

# The least validation size by frequency; None stands for any other.
FOLD_SIZE = {"D": 14, "W": 4, "MS": 3, "QS": 2, "YS": 1, None: 5}
MIN_TRAIN, MIN_LEFT, MIN_FOLD = 30, 10, 7
CATALOG = [
    ("naive", "baseline", "repeats the last value"),
    ("seasonal_naive", "baseline", "repeats the last season"),
    ("ets", "exponential smoothing", "additive trend and season with fitted weights"),
    ("arima", "ARIMA", "order of least AIC from a fixed list, with a season where there is data for it"),
    ("xgboost", "gradient boosting", "recursive boosted trees on calendar, lag and rolling features"),
]
FORECAST_SCHEMA = "series_id string, model string, fold int, h int, yhat double, lower double, upper double, error string, meta string"


@dataclass(frozen=True)
class Model:
    """A forecaster: fit(y, days, horizon, context) -> (forecast, lower, upper, metadata).  Custom ones run like the built-in."""

    name: str
    fit: Callable[[np.ndarray, np.ndarray, int, dict], tuple[np.ndarray, np.ndarray, np.ndarray, dict]]
    options: dict = field(default_factory=dict)


def list_models(spark) -> DataFrame:
    return spark.createDataFrame([(k, *row) for k, row in enumerate(CATALOG)], "model_order int, name string, family string, description string")


def size_guess(available: int, folds_left: int, frequency: str) -> int:
    return min(max(FOLD_SIZE.get(frequency, FOLD_SIZE[None]), available // folds_left), available)


def plan_folds(series: DataFrame, folds: int = 4, train_frac: float = 0.6, horizon: int | None = None) -> DataFrame:
    """series_id, fold (from 1), train_end, val_end, size: expanding training windows.  Needs a column frequency.

    Series with too little left after the first training window have no folds.  The plan is an expression over the
    series' length, so no length reaches the driver.
    """
    n = series.groupBy("series_id", "frequency").agg(F.count("*").cast("int").alias("n"))
    start = n.withColumn("first", F.greatest(F.lit(MIN_TRAIN), F.floor(F.col("n") * train_frac)).cast("int"))
    start = start.where(F.col("n") - F.col("first") >= MIN_LEFT)
    default = F.lit(FOLD_SIZE[None])
    for name, size in FOLD_SIZE.items():
        if name:
            default = F.when(F.col("frequency") == name, size).otherwise(default)

    def add(state: Column, i: Column) -> Column:
        left = state["left"]
        guess = F.least(F.greatest(default, F.floor(left / (folds - i))), left) if horizon is None else F.least(F.lit(horizon), left)
        size = F.least(F.greatest(F.lit(MIN_FOLD), guess), left).cast("int")
        return F.struct((left - size).alias("left"), F.concat(state["sizes"], F.array(size)).alias("sizes"))

    zero = F.struct((F.col("n") - F.col("first")).cast("int").alias("left"), F.expr("cast(array() as array<int>)").alias("sizes"))
    sizes = start.withColumn("s", F.aggregate(F.sequence(F.lit(0), F.lit(folds - 1)), zero, add)["sizes"])
    rows = sizes.select("series_id", "frequency", "first", "s", F.posexplode("s").alias("i", "size")).where("size > 0")
    before = F.aggregate(F.slice("s", F.lit(1), F.col("i")), F.lit(0), lambda a, x: a + x)
    out = rows.withColumn("train_end", F.col("first") + before)
    return out.select("series_id", "frequency", (F.col("i") + 1).alias("fold"), "train_end", (F.col("train_end") + F.col("size")).alias("val_end"), "size")


def _steps(folds: DataFrame) -> DataFrame:
    return folds.withColumn("h", F.explode(F.sequence(F.lit(1), F.col("size")))).withColumn("t", F.col("train_end") + F.col("h") - 1)


def naive_forecasts(series: DataFrame, folds: DataFrame) -> DataFrame:
    """The last training value for every step, with a band from the spread of first differences.  Equal joins on (series, place)."""
    own = with_position(series).withColumn("d", F.col("y") - F.lag("y").over(by_time()))
    own = own.withColumn("sigma", F.coalesce(F.stddev_pop("d").over(by_time()), F.lit(0.0)))
    ends = folds.withColumn("t", F.col("train_end") - 1).join(own.select("series_id", "t", "y", "sigma"), ["series_id", "t"])
    out = _steps(ends.drop("t")).withColumn("half", 1.96 * F.col("sigma") * F.sqrt("h"))
    return out.select("series_id", F.lit("naive").alias("model"), "fold", "h", F.col("y").alias("yhat"), (F.col("y") - F.col("half")).alias("lower"), (F.col("y") + F.col("half")).alias("upper"))


def seasonal_naive_forecasts(series: DataFrame, folds: DataFrame, season: int | str = 7) -> DataFrame:
    """The value one season before, over again.  season: a number of rows, or a column of folds.  Below one season: the last value."""
    length = F.lit(season) if isinstance(season, int) else F.col(season)
    own = with_position(series)
    plan = _steps(folds.withColumn("L", length))
    place = F.when(F.col("train_end") >= F.col("L"), F.col("train_end") - F.col("L") + F.pmod(F.col("h") - 1, F.col("L"))).otherwise(F.col("train_end") - 1)
    found = plan.withColumn("src", place.cast("int")).join(own.select("series_id", F.col("t").alias("src"), F.col("y").alias("yhat")), ["series_id", "src"])
    gaps = own.select("series_id", "t", F.col("y").alias("y1"))
    lags = folds.select("series_id", length.alias("L")).distinct()
    diffs = gaps.join(lags, "series_id").join(gaps.select("series_id", (F.col("t")).alias("t0"), F.col("y1").alias("y0")).withColumnRenamed("series_id", "s2"), (F.col("series_id") == F.col("s2")) & (F.col("t0") == F.col("t") - F.col("L")), "left")
    w = Window.partitionBy("series_id", "L").orderBy("t")
    spread = diffs.select("series_id", "L", (F.col("t") + 1).alias("train_end"), F.coalesce(F.stddev_pop(F.col("y1") - F.col("y0")).over(w), F.lit(0.0)).alias("sigma"))
    out = found.join(spread, ["series_id", "L", "train_end"]).withColumn("half", 1.96 * F.col("sigma") * F.sqrt("h"))
    return out.select("series_id", F.lit("seasonal_naive").alias("model"), "fold", "h", "yhat", (F.col("yhat") - F.col("half")).alias("lower"), (F.col("yhat") + F.col("half")).alias("upper"))


def _arima(y: np.ndarray, days: np.ndarray, horizon: int, context: dict):
    return fitting.fit_arima(y, horizon, context["frequency"])


def trees(n_trees: int = 300, compat: bool = False) -> Model:
    def fit(y: np.ndarray, days: np.ndarray, horizon: int, context: dict):
        return fitting.fit_trees(y, days, horizon, context["frequency"], n_trees, compat)

    return Model("xgboost", fit)


ARIMA = Model("arima", _arima)
#: Rows that a series needs for boosted trees.
MIN_TREES = 40


def numeric_forecasts(series: DataFrame, folds: DataFrame, models: Iterable[Model]) -> DataFrame:
    """Forecasts of numeric models: one Arrow group per (series, fold, model), a failure stays in its row.

    folds may have a column periods (seasons detected in the series).
    """
    chosen = {m.name: m for m in models}
    own = with_position(series)
    plan = folds if "periods" in folds.columns else folds.withColumn("periods", F.expr("cast(array() as array<int>)"))
    names = F.array(*map(F.lit, chosen))
    plan = plan.select("series_id", "fold", "train_end", "size", "frequency", "periods", F.explode(names).alias("model"))
    if "xgboost" in chosen:  # series that are too short for trees do without
        short = series.groupBy("series_id").count().where(F.col("count") < MIN_TREES).select("series_id", F.lit("xgboost").alias("model"))
        plan = plan.join(short, ["series_id", "model"], "left_anti")
    # the training window as a residual condition of an equal join on the series
    rows = own.join(plan, "series_id").where("t < train_end").select("series_id", "fold", "model", "t", "ts", "y", "size", "frequency", "periods")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        first = part.iloc[0]
        size = int(first["size"])
        key = {"series_id": first["series_id"], "model": first["model"], "fold": int(first["fold"])}
        y, days = part["y"].to_numpy(float), part["ts"].to_numpy("datetime64[ns]")
        try:
            fc, low, high, meta = chosen[first["model"]].fit(y, days, size, {"frequency": first["frequency"], "periods": [int(p) for p in first["periods"]]})
            fc = np.asarray(fc, float)
            if len(fc) < size:  # a short forecast is carried on with its last value
                fc, low, high = (np.r_[v, np.full(size - len(v), v[-1])] for v in (fc, np.asarray(low, float), np.asarray(high, float)))
            meta = json.dumps({k: v for k, v in meta.items() if k != "residuals"}, default=str)
            return pd.DataFrame({**key, "h": np.arange(1, size + 1), "yhat": fc[:size], "lower": np.asarray(low)[:size], "upper": np.asarray(high)[:size], "error": None, "meta": meta})
        except Exception as e:  # one model on one window; the others go on
            return pd.DataFrame({**key, "h": [0], "yhat": [None], "lower": [None], "upper": [None], "error": [str(e)[:200]], "meta": [None]})

    # fits are long and their rows few, so groups are dealt to more tasks than their bytes would ask for
    tasks = 4 * int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "series_id", "fold", "model").groupBy("series_id", "fold", "model").applyInPandas(run, FORECAST_SCHEMA)


def score_folds(series: DataFrame, folds: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Per series, model and fold: the five metrics and n; forecasts meet actuals on (series, place)."""
    actual = with_position(series).select("series_id", "t", "y")
    keyed = forecasts.join(folds.select("series_id", "fold", "train_end"), ["series_id", "fold"]).withColumn("t", F.col("train_end") + F.col("h") - 1)
    pairs = keyed.join(actual, ["series_id", "t"])
    return pairs.groupBy("series_id", "model", "fold").agg(*[c.alias(k) for k, c in metric_columns().items()], F.count("*").alias("n"))


def leaderboard(scores: DataFrame, metric: str = "smape", total_folds: DataFrame | None = None) -> DataFrame:
    """Per series and model: metrics over folds (weighted by size, mape plain), rank by the metric, and which is best.

    Ties go to the model that comes first in the catalogue; models without a value are not ranked.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    weighted = lambda m: F.sum(F.when(F.col(m).isNotNull(), F.col(m) * F.col("n"))) / F.sum(F.when(F.col(m).isNotNull(), F.col("n")))
    cols = [F.round(F.avg(m) if m == "mape" else weighted(m), 4).alias(m) for m in METRICS]
    out = scores.groupBy("series_id", "model").agg(*cols, F.count("*").alias("n_folds_valid"))
    order = F.coalesce(F.array_position(F.array(*[F.lit(c[0]) for c in CATALOG]), F.col("model")), F.lit(0))
    order = F.when(order > 0, order).otherwise(len(CATALOG) + 1)
    w = Window.partitionBy("series_id").orderBy(F.col(metric).isNull(), metric, order, "model")
    out = out.withColumn("rank", F.when(F.col(metric).isNotNull(), F.row_number().over(w)))
    if total_folds is not None:
        out = out.join(total_folds, "series_id", "left")
    return out.withColumn("is_best", F.coalesce(F.col("rank") == 1, F.lit(False)))


def season_lengths(series: DataFrame, frequency: str = "D") -> DataFrame:
    """Per series: the length a seasonal naive forecast uses (the detected season, else 7) and all detected seasons."""
    found = detect_seasonality(series, frequency)
    periods = F.array_sort(F.transform(F.map_values("periods"), lambda x: x["period"]))
    return found.select("series_id", F.coalesce("period", F.lit(7)).alias("season"), periods.alias("periods"))


def model_forecasts(series: DataFrame, folds: DataFrame, models: Iterable[str | Model], n_trees: int = 300) -> DataFrame:
    """Forecasts (FORECAST_SCHEMA) of models by name or of one's own, for each of the folds.

    The baselines and exponential smoothing are relations; the others are fitted in Arrow groups.  The seasonal naive forecast takes
    the season of folds' column season, else 7.
    """
    season = "season" if "season" in folds.columns else 7
    made = {"naive": lambda: naive_forecasts(series, folds), "seasonal_naive": lambda: seasonal_naive_forecasts(series, folds, season), "ets": lambda: ets_forecasts(series, folds)}
    fitted = {"arima": lambda: ARIMA, "xgboost": lambda: trees(n_trees)}
    none = F.lit(None).cast("string")
    parts, numeric = [], []
    for m in models:
        if isinstance(m, Model):
            numeric.append(m)
        elif m in made:
            part = made[m]()
            parts.append(part if "meta" in part.columns else part.withColumns({"error": none, "meta": none}))
        elif m in fitted:
            numeric.append(fitted[m]())
        else:
            raise UnknownModel(m)
    if numeric:
        parts.append(numeric_forecasts(series, folds, numeric))
    return functools.reduce(DataFrame.unionByName, parts)


def backtest(series: DataFrame, frequency: str = "D", folds: int = 4, train_frac: float = 0.6, horizon: int | None = None, metric: str = "smape", models: Iterable[str | Model] = ("naive", "seasonal_naive", "ets", "arima", "xgboost"), n_trees: int = 300) -> dict[str, DataFrame]:
    """folds, forecasts, scores and leaderboard of all series and models."""
    plan = plan_folds(series.withColumn("frequency", F.lit(frequency)), folds, train_frac, horizon)
    plan = plan.join(season_lengths(series, frequency), "series_id").persist(StorageLevel.MEMORY_AND_DISK)  # a few rows a series, read by every model
    forecasts = model_forecasts(series, plan, models, n_trees)
    scores = score_folds(series, plan, forecasts.where("error is null"))
    totals = plan.groupBy("series_id").agg(F.count("*").alias("n_folds_total"))
    return {"folds": plan, "forecasts": forecasts, "scores": scores, "leaderboard": leaderboard(scores, metric, totals)}


def holdout_folds(series: DataFrame, frequency: str = "D") -> DataFrame:
    """One fold per series: the last min(7, max(1, a tenth)) rows."""
    n = series.groupBy("series_id").agg(F.count("*").cast("int").alias("n"))
    size = F.least(F.lit(7), F.greatest(F.lit(1), F.floor(F.col("n") * 0.1))).cast("int")
    return n.select("series_id", F.lit(frequency).alias("frequency"), F.lit(1).alias("fold"), (F.col("n") - size).alias("train_end"), F.col("n").alias("val_end"), size.alias("size"))


def final_fold(series: DataFrame, horizon: int, frequency: str = "D") -> DataFrame:
    """The whole series as training window and `horizon` steps beyond it."""
    n = series.groupBy("series_id").agg(F.count("*").cast("int").alias("train_end"))
    return n.select("series_id", F.lit(frequency).alias("frequency"), F.lit(0).alias("fold"), "train_end", (F.col("train_end") + horizon).alias("val_end"), F.lit(horizon).alias("size"))


def holt_winters_fixed(series: DataFrame, alpha: float = 0.3, beta: float = 0.1) -> DataFrame:
    """Level and trend of Holt's method with given weights, as a fold over each series' values in SQL."""
    values = with_position(series).groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: x["y"]).alias("ys"))
    start = F.struct(F.col("ys")[0].alias("level"), F.lit(0.0).alias("slope"))

    def step(s: Column, v: Column) -> Column:
        ahead = s["level"] + s["slope"]
        level = alpha * v + (1 - alpha) * ahead
        return F.struct(level.alias("level"), (beta * (level - s["level"]) + (1 - beta) * s["slope"]).alias("slope"))

    return values.select("series_id", F.aggregate(F.slice("ys", 2, F.size("ys")), start, step).alias("s")).select("series_id", "s.level", "s.slope")

"""The whole analysis: validate, clean, explore, backtest, select, refit, forecast, explain, brief."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InsufficientHistory
from ..functions.calendar import step
from ..operators import backtest as bt
from ..operators import clean, explain, explore, intervals, validate
from ..series import at_least, short_series
from ..sources import readers

MIN_PIPELINE, MIN_API = 30, 40


@dataclass(frozen=True)
class PipelineConfig:
    date_col: str = "date"
    target_col: str = "target"
    series_col: str | None = None
    seq_col: str | None = None
    frequency: str | None = None  # None: detected, the commonest of the series
    horizon: int = 30
    folds: int = 4
    fold_horizon: int | None = None
    train_frac: float = 0.6
    metric: str = "smape"
    models: tuple[str, ...] = ("naive", "seasonal_naive", "ets", "arima")
    include_xgboost: bool = True
    n_trees: int = 300
    coverage: float = 0.95
    min_rows: int = MIN_PIPELINE
    custom_models: tuple[bt.Model, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if not 1 <= self.horizon <= 365:
            raise ValueError("horizon must be from 1 to 365")
        if not 1 <= self.folds <= 10:
            raise ValueError("folds must be from 1 to 10")
        if not 0.1 < self.train_frac < 0.95:
            raise ValueError("train_frac must be between 0.1 and 0.95")
        if self.metric not in bt.METRICS:
            raise ValueError(f"unknown metric: {self.metric}")


@dataclass
class PipelineResult:
    quality: DataFrame
    series: DataFrame
    skipped: DataFrame
    exploration: DataFrame
    folds: DataFrame
    scores: DataFrame
    leaderboard: DataFrame
    forecast: DataFrame
    change: DataFrame
    explanation: DataFrame
    summary: DataFrame
    brief: DataFrame
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Give back the storage of what later parts were read from; the DataFrames still work, by computing it again."""
        for df in self.held:
            df.unpersist()


def _models(c: PipelineConfig) -> list[str | bt.Model]:
    return [*c.models, *["xgboost"] * c.include_xgboost, *c.custom_models]


def frequency_of(series: DataFrame, c: PipelineConfig) -> str:
    """The configured frequency, else the commonest one of the series; D for no series at all."""
    if c.frequency:
        return c.frequency
    first = validate.detect_frequency(series).groupBy("frequency").count().orderBy(F.desc("count"), "frequency").first()
    return first[0] if first else "D"


def run(spark: SparkSession, df: DataFrame, config: PipelineConfig | None = None) -> PipelineResult:
    """Validation sees the raw rows.  Series that are too short are told in `skipped`; if none is left, that is an error."""
    c = config or PipelineConfig()
    quality = validate.quality_report(df, c.date_col, c.target_col, c.series_col, c.seq_col)
    cleaned = clean.preprocess(df, c.date_col, c.target_col, c.series_col, c.seq_col)
    series = at_least(cleaned, c.min_rows).persist(StorageLevel.MEMORY_AND_DISK)
    if series.isEmpty():
        raise InsufficientHistory(f"needs at least {c.min_rows} rows")
    frequency = frequency_of(series, c)
    trend, season, volatility = explore.trend(series), explore.detect_seasonality(series, frequency), explore.volatility(series)
    stats = explore.summary_stats(series)
    tested = bt.backtest(series, frequency, c.folds, c.train_frac, c.fold_horizon, c.metric, _models(c), c.n_trees)
    board = tested["leaderboard"].persist(StorageLevel.MEMORY_AND_DISK)
    forecast = refit(series, board, frequency, c).persist(StorageLevel.MEMORY_AND_DISK)  # read by the change, the means and the ends
    last = series.groupBy("series_id").agg(F.max_by("y", "ts").alias("last_y"), F.max("ts").alias("last_ts"))
    change = intervals.expected_change(forecast, last)
    drivers = explain.explain(trend, season, volatility, stats)
    anomalies = explore.anomaly_digest(explore.iqr_anomalies(series))
    summary = explain.structured_input(board, change, intervals.horizon_means(forecast), trend, season, drivers, quality, c.horizon, intervals.horizon_ends(forecast), volatility, anomalies)
    return PipelineResult(quality, series, short_series(cleaned, c.min_rows), explore.explore(spark, series, frequency), tested["folds"], tested["scores"], board, forecast, change, drivers, summary, explain.brief(summary), (series, tested["folds"], board, forecast))


def refit(series: DataFrame, board: DataFrame, frequency: str, c: PipelineConfig) -> DataFrame:
    """The best model of each series on all of it: series_id, model, h, ds, yhat, lower, upper."""
    best = board.where("is_best").select("series_id", "model")
    fold = bt.final_fold(series, c.horizon, frequency).join(bt.season_lengths(series, frequency), "series_id").join(best, "series_id").persist(StorageLevel.MEMORY_AND_DISK)
    names = {r[0] for r in fold.select("model").distinct().collect()}  # names of models, a handful
    custom = {m.name: m for m in c.custom_models}
    parts = [bt.model_forecasts(series, fold.where(F.col("model") == name).drop("model"), [custom.get(name, name)], c.n_trees) for name in sorted(names)]
    cols = ["series_id", "model", "fold", "h", "yhat", "lower", "upper"]
    out = functools.reduce(DataFrame.unionByName, parts).where("error is null").select(*cols)
    last = series.groupBy("series_id").agg(F.max("ts").alias("last_ts"))
    return out.join(last, "series_id").select("series_id", "model", "h", step(F.col("last_ts"), F.col("h"), F.lit(frequency)).alias("ds"), "yhat", "lower", "upper")


# Functions of the service surface, on named datasets


def health() -> dict:
    return {"status": "ok"}


def register_dataset(spark: SparkSession, path: str, name: str | None = None) -> str:
    return readers.upload(spark, path, name)


def list_datasets(spark: SparkSession) -> list[str]:
    return readers.list_datasets(spark)


def validate_dataset(spark: SparkSession, name: str | None = None, config: PipelineConfig | None = None) -> DataFrame:
    c = config or PipelineConfig()
    return validate.quality_report(readers.resolve(spark, name), c.date_col, c.target_col, c.series_col, c.seq_col)


def _series(spark: SparkSession, name: str | None, c: PipelineConfig, least: int = 0) -> DataFrame:
    out = clean.preprocess(readers.resolve(spark, name), c.date_col, c.target_col, c.series_col, c.seq_col)
    if least:
        out = at_least(out, least)
        if out.isEmpty():
            raise InsufficientHistory(f"needs at least {least} rows")
    return out


def explore_dataset(spark: SparkSession, name: str | None = None, config: PipelineConfig | None = None) -> DataFrame:
    c = config or PipelineConfig()
    series = _series(spark, name, c)
    return explore.explore(spark, series, frequency_of(series, c))


def train_summary(spark: SparkSession, name: str | None = None, config: PipelineConfig | None = None, models: Iterable[str] = ("naive", "seasonal_naive", "ets", "arima")) -> DataFrame:
    """Each model fitted without the last rows and its mean absolute error there; a failing model tells its error."""
    c = config or PipelineConfig()
    series = _series(spark, name, c, MIN_API)
    frequency = frequency_of(series, c)
    fold = bt.holdout_folds(series, frequency).join(bt.season_lengths(series, frequency), "series_id")
    return holdout_mae(series, fold, models)


def holdout_mae(series: DataFrame, fold: DataFrame, models: Iterable[str]) -> DataFrame:
    out = bt.model_forecasts(series, fold, models)
    scores = bt.score_folds(series, fold, out.where("error is null")).select("series_id", "model", F.round("mae", 4).alias("holdout_mae"))
    errors = out.where("error is not null").select("series_id", "model", "error").distinct()
    return scores.join(errors, ["series_id", "model"], "full")


def evaluate(spark: SparkSession, name: str | None = None, config: PipelineConfig | None = None) -> DataFrame:
    c = config or PipelineConfig()
    series = _series(spark, name, c, MIN_API)
    return bt.backtest(series, frequency_of(series, c), c.folds, c.train_frac, c.fold_horizon, c.metric, _models(c), c.n_trees)["leaderboard"]


def forecast(spark: SparkSession, name: str | None = None, config: PipelineConfig | None = None) -> PipelineResult:
    """The whole analysis of a named dataset; series of fewer than 40 rows are left out, and without any other that is an error."""
    c = config or PipelineConfig()
    return run(spark, readers.resolve(spark, name), replace(c, min_rows=max(c.min_rows, MIN_API)))


def explain_dataset(spark: SparkSession, name: str | None = None, config: PipelineConfig | None = None) -> DataFrame:
    return forecast(spark, name, config).explanation


def recommend(spark: SparkSession, name: str | None = None, config: PipelineConfig | None = None, interpreter: Callable[[str], str] | None = None, enabled: bool = False) -> DataFrame:
    return explain.generate(forecast(spark, name, config).summary, interpreter, enabled)

"""Registered queries of the time-series engine: name to (spark, sf_dir) -> DataFrame.  Their SQL is in oracle.py."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.calendar import calendar_columns, future_dates, future_features
from .operators import backtest as bt
from .operators import attribution, clean, explain, explore, features, intervals, metrics, quantiles, validate
from .oracle import ORACLE_SQL
from .plans import pipeline
from .series import at_least, short_series, to_series, with_position
from .sources.catalogue import Catalogue
from .sources.readers import business_demand, infer_columns, list_datasets, load_csv, put, resolve, write_csv
from .sources.workbook import write_workbook
from .storage import shared_folder
from .streaming.live import bucket_stream

__all__ = ["ORACLE_SQL", "QUERIES"]

HORIZON = 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def _thousands(series: DataFrame) -> DataFrame:
    return series.withColumn("y", F.col("y") / 1000)


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thousands(to_series(table(spark, sf_dir, "orders"), F.to_date("o_orderdate"), _money("o_totalprice")))


def orders_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thousands(to_series(table(spark, sf_dir, "orders"), F.to_date("o_orderdate"), _money("o_totalprice"), F.col("o_orderpriority")))


def orders_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region names reach the orders over three joins; the dimension tables are small enough for Spark to broadcast by their own size."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return _thousands(to_series(joined, F.to_date("o_orderdate"), _money("o_totalprice"), F.col("r_name")))


def lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thousands(to_series(table(spark, sf_dir, "lineitem"), F.to_date("l_shipdate"), _money("l_extendedprice"), F.col("l_returnflag")))


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with dates and targets as text, some of them unreadable or missing, several rows per day."""
    e = table(spark, sf_dir, "events")
    date = F.when(F.col("event_id") % 17 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    target = F.when(F.col("event_id") % 11 == 0, "n/a").when(F.col("event_id") % 13 == 0, None).otherwise(F.round("value", 2).cast("decimal(18,2)").cast("string"))
    return e.select("event_type", date.alias("date"), target.alias("target"), "event_id")


def _r(*columns: str, digits: int = 4) -> list[Column]:
    return [F.round(c, digits).alias(c) for c in columns]


def _as_sql(*columns: str, digits: int) -> list[Column]:
    """Rounded by way of a product in double precision, as the SQL does; F.round takes the shortest decimal form of a number."""
    return [(F.round(F.col(c) * 10.0**digits) / 10.0**digits).alias(c) for c in columns]


def series_build(spark, d):
    return orders_by_priority(spark, d).select("series_id", "ts", "y")


def series_by_region(spark, d):
    return orders_by_region(spark, d).select("series_id", "ts", "y")


def coerce_clean(spark, d):
    return clean.preprocess(messy(spark, d), series_col="event_type", seq_col="event_id").select("series_id", F.to_date("ts").alias("ts"), "y")


def cleaning_log(spark, d):
    return clean.cleaning_log(messy(spark, d), series_col="event_type").withColumn("transformations", F.array_join("transformations", "; "))


def dedup_keep_last(spark, d):
    rows = clean.coerce(table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts")), "hour", "value", "event_type", "event_id")
    return clean.keep_last(rows).select("series_id", "ts", *_r("y"))


def min_history(spark, d):
    users = to_series(table(spark, d, "events"), F.to_date("ts"), F.lit(1), F.col("user_id").cast("string"))
    kept = at_least(users, 8).groupBy("series_id").agg(F.count("*").alias("n")).withColumn("reason", F.lit(None).cast("string"))
    return kept.unionByName(short_series(users, 8))


def _frequency_mix(spark, d):
    o = table(spark, d, "orders")
    grid = lambda unit: to_series(o, F.trunc(F.to_date("o_orderdate"), unit), _money("o_totalprice"), F.lit(unit))
    week = to_series(o, F.to_date(F.date_trunc("week", "o_orderdate")), _money("o_totalprice"), F.lit("week"))
    out = orders_by_priority(spark, d)
    for s in (grid("month"), grid("quarter"), grid("year"), week):
        out = out.unionByName(s)
    return out


def freq_detect(spark, d):
    return validate.detect_frequency(_frequency_mix(spark, d))


def quality_report(spark, d):
    report = validate.quality_report(messy(spark, d), series_col="event_type", seq_col="event_id", allow_negative=False)
    issues = F.array_join(F.transform("issues", lambda x: F.concat(x["severity"], F.lit(":"), x["category"], F.lit(":"), x["message"])), "; ")
    return report.withColumn("issues", issues).withColumns({"start_ts": F.to_date("start_ts"), "end_ts": F.to_date("end_ts")})


def calendar(spark, d):
    days = orders_daily(spark, d).select("ts").withColumns(calendar_columns(F.col("ts")))
    trig = [c for c in days.columns if c.startswith(("sin_", "cos_"))]
    return days.withColumns({c: F.round(c, 6) + 0.0 for c in trig})


def lags(spark, d):
    return orders_by_priority(spark, d).withColumns(features.lag_columns([1, 2, 3, 7, 14, 28])).select("series_id", "ts", "lag_1", "lag_2", "lag_3", "lag_7", "lag_14", "lag_28")


def rolling(spark, d):
    out = orders_by_priority(spark, d).withColumns(features.rolling_columns([7, 28]))
    exact = [c for c in out.columns if c.startswith(("rolling_min", "rolling_max"))]
    return out.select("series_id", "ts", *exact, *_r(*[c for c in out.columns if c.startswith(("rolling_mean", "rolling_std"))], digits=7))


def momentum(spark, d):
    out = orders_by_priority(spark, d).withColumns(features.rolling_columns([7], std=False, extremes=False))
    return features.add_momentum(out, "rolling_mean_7").select("series_id", "ts", *_r("momentum", digits=6))


def feature_frame(spark, d):
    out = features.feature_frame(orders_daily(spark, d), "D", windows=[7, 14])
    kept = [c for c in out.columns if c not in ("series_id", "ts")]
    exact = lambda c: c == "y" or c.startswith(("lag_", "rolling_min", "rolling_max"))
    return out.select("series_id", "ts", *[(F.round(c, 7) + 0.0).alias(c) if t == "double" and not exact(c) else F.col(c) for c, t in out.dtypes if c in kept])


def differences(spark, d):
    return features.differences(orders_by_priority(spark, d)).select("series_id", "ts", "diff_1", "diff_7")


def rolling_band(spark, d):
    return features.rolling_band(orders_daily(spark, d)).select("series_id", "ts", *_r("roll_mean", "roll_std", "band_low", "band_high", digits=3))


def preprocess_summary(spark, d):
    return clean.summary(orders_by_priority(spark, d)).select("series_id", "n", "start_ts", "end_ts", "min", "max", "recent", *_r("mean", "std", digits=3))


def summary_stats(spark, d):
    out = explore.summary_stats(orders_by_priority(spark, d))
    return out.select("series_id", "min", "max", "first", "recent", "latest_change_pct", *_r("mean", "std", digits=3), F.round("median", 6).alias("median"))


def trend_ols(spark, d):
    return explore.trend(orders_by_priority(spark, d)).select("series_id", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("t_stat", 3).alias("t_stat"), F.round("slope_pct", 3).alias("slope_pct"), "direction")


def volatility(spark, d):
    return explore.volatility(orders_by_priority(spark, d))


def histogram(spark, d):
    return explore.histogram(orders_by_priority(spark, d))


def _decomposed(period: int):
    def query(spark, d):
        return explore.decompose(lineitem_daily(spark, d), period).select("series_id", "ts", *[(F.round(c, 3) + 0.0).alias(c) for c in ("y", "trend", "seasonal", "resid")])

    return query


def seasonal_strength(spark, d):
    out = explore.seasonal_strengths(lineitem_daily(spark, d), explore.SEASONS["D"]).where("name is not null")
    return out.select("series_id", "period", *_r("strength"))


def seasonality_detect(spark, d):
    out = explore.detect_seasonality(lineitem_daily(spark, d), "D")
    periods = F.array_join(F.transform(F.map_entries("periods"), lambda x: F.concat(x["key"], F.lit("="), x["value"]["period"].cast("string"))), ",")
    return out.select("series_id", "detected", "seasonality_type", "period", "strength", periods.alias("periods"), "note")


def periodicity(spark, d):
    out = explore.detect_periodicity(lineitem_daily(spark, d), "D")
    return out.select("series_id", "primary", F.round(F.col("periods")["weekly"]["strength"], 4).alias("weekly"), F.round(F.col("periods")["yearly"]["strength"], 4).alias("yearly"))


def decomposition_summary(spark, d):
    return explore.decomposition_summary(lineitem_daily(spark, d), 7).select("series_id", *_r("trend_last", "seasonal_max", "resid_std", digits=3))


def iqr_anomalies(spark, d):
    return explore.detect_anomalies(orders_by_priority(spark, d), "iqr", multiple=1.0).select("series_id", "ts", "y", *_r("low", "high", digits=7), "is_anomaly")


def rolling_mad(spark, d):
    return explore.detect_anomalies(orders_by_priority(spark, d), "rolling").select("series_id", "ts", "y", *_r("med", "mad", digits=7), "is_anomaly")


def anomaly_digest(spark, d):
    out = explore.anomaly_digest(explore.iqr_anomalies(orders_by_priority(spark, d), 1.0), "iqr_x1.0", 10)
    return out.withColumn("dates", F.array_join(F.transform("dates", lambda x: x.cast("string")), ","))


# Series of any length: one series of every event, cut into blocks of LONG_ROWS rows; quantiles in bounded memory

LONG_ROWS = 4096


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series by their exact time."""
    return to_series(table(spark, sf_dir, "events"), F.col("ts"), F.round("value", 2).cast("decimal(18,2)"))


def long_rolling(spark, d):
    out = features.rolling(events_series(spark, d), [7, 28], rows=LONG_ROWS)
    exact = [c for c in out.columns if c.startswith(("rolling_min", "rolling_max"))]
    return out.select("series_id", "ts", *exact, *_r(*[c for c in out.columns if c.startswith(("rolling_mean", "rolling_std"))], digits=6))


def long_features(spark, d):
    out = features.feature_frame(events_series(spark, d), "D", lags=[1, 7, 365], windows=[7, 90], calendar=False, rows=LONG_ROWS)
    return out.select("series_id", "ts", "lag_1", "lag_7", "lag_365", *_as_sql("rolling_mean_7", "rolling_mean_90", "momentum", digits=6))


def long_rolling_mad(spark, d):
    out = explore.rolling_anomalies(events_series(spark, d), rows=LONG_ROWS)
    return out.select("series_id", "ts", "y", *_r("med", "mad", digits=6), "is_anomaly")


def long_quantiles(spark, d):
    """Exact quantiles of all prices of each return flag."""
    lines = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("series_id"), F.col("l_extendedprice").alias("y"))
    out = quantiles.exact_quantiles(lines, (0.01, 0.25, 0.5, 0.75, 0.99))
    return out.select("series_id", "n", *[F.round(F.col("q")[k], 6).alias(name) for k, name in enumerate(("q01", "q25", "q50", "q75", "q99"))])


def long_summary(spark, d):
    out = explore.summary_stats(events_series(spark, d), bounded=True)
    return out.select("series_id", "min", "max", "first", "recent", "latest_change_pct", *_r("mean", "std", digits=3), F.round("median", 6).alias("median"))


def long_iqr(spark, d):
    out = explore.iqr_anomalies(events_series(spark, d), 1.5, bounded=True)
    return out.select("series_id", "ts", "y", *_r("low", "high", digits=6), "is_anomaly")


def _folds(spark, d, by=orders_by_priority):
    series = by(spark, d)
    return series, bt.plan_folds(series.withColumn("frequency", F.lit("D")))


def folds(spark, d):
    return _folds(spark, d)[1]


def naive_forecasts(spark, d):
    return bt.naive_forecasts(*_folds(spark, d)).select("series_id", "model", "fold", "h", *_r("yhat", "lower", "upper", digits=3))


def seasonal_naive_forecasts(spark, d):
    return bt.seasonal_naive_forecasts(*_folds(spark, d)).select("series_id", "model", "fold", "h", *_r("yhat", "lower", "upper", digits=3))


def _simple_scores(spark, d):
    series, plan = _folds(spark, d)
    made = bt.naive_forecasts(series, plan).unionByName(bt.seasonal_naive_forecasts(series, plan))
    return plan, bt.score_folds(series, plan, made)


def metrics_by_fold(spark, d):
    return _simple_scores(spark, d)[1].select("series_id", "model", "fold", *_r(*metrics.METRICS), "n")


def leaderboard(spark, d):
    """Flagship: daily series by priority, four expanding folds, naive and seasonal naive, ranked by sMAPE."""
    plan, scores = _simple_scores(spark, d)
    return bt.leaderboard(scores, "smape", plan.groupBy("series_id").agg(F.count("*").alias("n_folds_total")))


def mase(spark, d):
    series, plan = _folds(spark, d)
    made = bt.naive_forecasts(series, plan).join(plan.select("series_id", "fold", "train_end"), ["series_id", "fold"]).withColumn("t", F.col("train_end") + F.col("h") - 1)
    return metrics.scaled_error(made.join(with_position(series).select("series_id", "t", "y"), ["series_id", "t"]), "series_id", "fold")


def holdout_mae(spark, d):
    series = orders_by_priority(spark, d)
    return pipeline.holdout_mae(series, bt.holdout_folds(series), ["naive", "seasonal_naive"])


def horizon_dates(spark, d):
    last = orders_daily(spark, d).agg(F.max("ts").alias("last_ts"))
    grid = last.withColumn("frequency", F.explode(F.array(*map(F.lit, ("D", "W", "MS", "QS", "YS", "IR")))))
    return future_dates(grid, 12).select("frequency", "h", "ds")


def _final(spark, d):
    series = orders_by_priority(spark, d)
    return series, bt.seasonal_naive_forecasts(series, bt.final_fold(series, HORIZON))


def gaussian_band(spark, d):
    series = orders_by_priority(spark, d)
    spread = series.groupBy("series_id").agg(F.stddev_pop("y").alias("sigma"), F.max_by("y", "ts").alias("yhat"))
    grid = spread.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(HORIZON)))).withColumn("coverage", F.explode(F.array(*map(F.lit, (0.8, 0.9, 0.95, 0.99)))))
    out = None
    for c in (0.8, 0.9, 0.95, 0.99):
        one = intervals.gaussian_band(grid.where(F.col("coverage") == c), coverage=c)
        out = one if out is None else out.unionByName(one)
    return out.select("series_id", "h", "coverage", *_r("yhat", "lower", "upper", digits=3))


def band_annotation(spark, d):
    return intervals.annotate(_final(spark, d)[1])


def expected_change(spark, d):
    series, made = _final(spark, d)
    last = series.groupBy("series_id").agg(F.max_by("y", "ts").alias("last_y"))
    return intervals.expected_change(made, last)


def horizon_means(spark, d):
    return intervals.horizon_means(_final(spark, d)[1])


def residual_diagnostics(spark, d):
    own = features.differences(orders_by_priority(spark, d), 7).select("series_id", F.col("ts").alias("t"), F.col("diff_7").alias("r"))
    return metrics.residual_diagnostics(own).drop("note")


def hw_fixed_params(spark, d):
    return bt.holt_winters_fixed(orders_daily(spark, d)).select("series_id", *_r("level", "slope", digits=3))


def drivers(spark, d):
    series = orders_by_priority(spark, d)
    out = explain.explain(explore.trend(series), explore.detect_seasonality(series, "D"), explore.volatility(series))
    said = F.array_join(F.transform("drivers", lambda x: F.concat(x["driver"], F.lit("="), x["direction"])), ",")
    return out.select("series_id", said.alias("drivers"), F.size("caveats").alias("n_caveats"))


def _summary(spark, d):
    series = orders_by_priority(spark, d).persist(StorageLevel.MEMORY_AND_DISK)  # read once, not once for each part
    plan = bt.plan_folds(series.withColumn("frequency", F.lit("D")))
    made = bt.naive_forecasts(series, plan).unionByName(bt.seasonal_naive_forecasts(series, plan))
    board = bt.leaderboard(bt.score_folds(series, plan, made))
    forecast = bt.seasonal_naive_forecasts(series, bt.final_fold(series, HORIZON))
    last = series.groupBy("series_id").agg(F.max_by("y", "ts").alias("last_y"), F.max("ts").alias("last_ts"))
    ahead = forecast.join(last, "series_id").withColumn("ds", F.date_add("last_ts", F.col("h").cast("int")))
    trend, season, volatility = explore.trend(series), explore.detect_seasonality(series, "D"), explore.volatility(series)
    told = explain.explain(trend, season, volatility)
    anomalies = explore.anomaly_digest(explore.iqr_anomalies(series))
    raw = series.withColumnRenamed("ts", "date").withColumnRenamed("y", "target")
    quality = validate.quality_report(raw, series_col="series_id")
    return explain.structured_input(board, intervals.expected_change(forecast, last), intervals.horizon_means(forecast), trend, season, told, quality, HORIZON, intervals.horizon_ends(ahead), volatility, anomalies)


#: What summary_numbers tells besides structured_summary.
NUMBERS = ("mae", "rmse", "mape", "trend_slope", "trend_slope_pct", "trend_p_value", "volatility_overall", "volatility_early", "volatility_recent", "volatility_ratio")


def summary_numbers(spark, d):
    out = _summary(spark, d).select("series_id", "best_model", "mae", "rmse", "mape", "smape", "wape", *NUMBERS[3:])
    return out.withColumns({c: F.round(c, 3) + 0.0 for c in NUMBERS[3:]})


def structured_summary(spark, d):
    out = _summary(spark, d).drop("drivers", "first_issue", "reference", *NUMBERS)
    return out.withColumns({c: F.round(c, 3) for c in ("end_value", "lower_end", "upper_end")}).withColumn("missing_values", F.col("missing_values").cast("int"))


def brief_text(spark, d):
    return explain.brief(_summary(spark, d))


def append_forecast(spark, d):
    series, made = _final(spark, d)
    last = series.groupBy("series_id").agg(F.max("ts").alias("last_ts"))
    ahead = made.join(last, "series_id").select("series_id", F.date_add("last_ts", F.col("h").cast("int")).alias("ts"), F.col("yhat").alias("y"), F.lit("forecast").alias("kind"))
    return series.select("series_id", "ts", "y", F.lit("history").alias("kind")).unionByName(ahead)


def model_catalog(spark, d):
    return bt.list_models(spark)


def event_buckets(spark, d):
    return bucket_stream(table(spark, d, "events"), key=F.col("event_type"), every="6 hours").select("series_id", "ts", F.round("y", 3).alias("y"), "n")


def column_inference(spark, d):
    """What the date column, the target and the numeric candidates of each table are taken to be."""
    found = [(t, *infer_columns(table(spark, d, t))) for t in SERVED]
    return spark.createDataFrame([(t, date, target, ",".join(numeric)) for t, date, target, numeric in found], "dataset string, date_col string, target_col string, numeric_cols string")


def dataset_catalog(spark, d):
    """Tables put into the catalogue of named datasets, and what it lists and resolves."""
    for t in SERVED:
        put(spark, t, table(spark, d, t))
    out = None
    for name in [n for n in list_datasets(spark) if n in SERVED]:
        one = resolve(spark, name)
        one = one.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("dataset"), "n_rows", F.lit(len(one.columns)).cast("long").alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


# Numeric models and random draws have no SQL form


def _numeric(spark, d, models):
    series = orders_by_priority(spark, d).persist(StorageLevel.MEMORY_AND_DISK)  # read once, not once for each part
    plan = bt.plan_folds(series.withColumn("frequency", F.lit("D"))).join(bt.season_lengths(series), "series_id").persist(StorageLevel.MEMORY_AND_DISK)
    made = bt.model_forecasts(series, plan, models)
    return bt.score_folds(series, plan, made.where("error is null")).select("series_id", "model", "fold", *_r(*metrics.METRICS), "n")


def ets_backtest(spark, d):
    return _numeric(spark, d, ["ets"])


def arima_backtest(spark, d):
    return _numeric(spark, d, ["arima"])


def gbt_backtest(spark, d):
    return _numeric(spark, d, ["xgboost"])


def all_models_leaderboard(spark, d):
    return bt.backtest(orders_daily(spark, d).persist(StorageLevel.MEMORY_AND_DISK), "D")["leaderboard"]


def feature_importance(spark, d):
    series = orders_daily(spark, d)
    made = bt.numeric_forecasts(series, bt.final_fold(series, 1), [bt.trees()])
    pairs = F.from_json(F.get_json_object("meta", "$.importance"), "array<array<string>>")
    rows = made.select("series_id", F.explode(pairs).alias("x")).select("series_id", F.col("x")[0].alias("feature"), F.round(F.col("x")[1].cast("double"), 6).alias("importance"))
    return explain.top_importances(rows)


def feature_attribution(spark, d):
    """Mean absolute Shapley values of the last hundred days."""
    return attribution.top_attributions(attribution.attributions(orders_daily(spark, d)))


def empirical_band(spark, d):
    series, made = _final(spark, d)
    resid = features.differences(series).select("series_id", F.col("ts").alias("t"), F.col("diff_7").alias("r"))
    return intervals.empirical_band(made.drop("lower", "upper"), resid).select("series_id", "h", *_r("yhat", "lower", "upper", digits=3), "method")


def sample_generator(spark, d):
    return business_demand(spark)


def full_pipeline(spark, d):
    """The whole analysis of the daily orders with its default settings."""
    raw = orders_daily(spark, d).withColumnsRenamed({"ts": "date", "y": "target"})
    return pipeline.run(spark, raw, pipeline.PipelineConfig(series_col="series_id")).brief


# The service functions on a named dataset, with the two models that SQL can express


def _serve(spark, d, horizon: int = HORIZON) -> tuple[str, pipeline.PipelineConfig]:
    put(spark, "service_orders", orders_by_priority(spark, d).withColumnsRenamed({"ts": "date", "y": "target"}))
    return "service_orders", pipeline.PipelineConfig(series_col="series_id", models=("naive", "seasonal_naive"), include_xgboost=False, horizon=horizon, frequency="D")


def service_validate(spark, d):
    out = pipeline.validate_dataset(spark, *_serve(spark, d))
    return out.select("series_id", "rows_in", "n", "frequency", "missing_days", "outliers", "score", "is_valid")


def service_explore(spark, d):
    out = pipeline.explore_dataset(spark, *_serve(spark, d))
    picked = {"mean": "summary_stats.mean", "median": "summary_stats.median", "trend_last": "decomposition.trend_last"}
    return out.select("series_id", *[F.round(c, 3).alias(k) for k, c in picked.items()], F.col("trend.direction").alias("trend"), F.col("volatility.level").alias("volatility"), F.col("seasonality.detected").alias("detected"), F.col("anomalies.count").alias("n_anomalies"))


def service_train(spark, d):
    name, c = _serve(spark, d)
    return pipeline.train_summary(spark, name, c, c.models)


def service_evaluate(spark, d):
    return pipeline.evaluate(spark, *_serve(spark, d))


def service_forecast(spark, d):
    out = pipeline.forecast(spark, *_serve(spark, d)).forecast
    return out.select("series_id", "model", "h", "ds", *_r("yhat", "lower", "upper", digits=3))


def service_explain(spark, d):
    """Drivers with the recent value."""
    out = pipeline.explain_dataset(spark, *_serve(spark, d))
    said = F.array_join(F.transform("drivers", lambda x: F.concat(x["driver"], F.lit("="), x["direction"])), ",")
    return out.select("series_id", said.alias("drivers"), F.size("caveats").alias("n_caveats"))


def service_recommend(spark, d):
    return pipeline.recommend(spark, *_serve(spark, d)).drop("llm_error")


def service_upload(spark, d):
    """The daily orders written as a workbook, uploaded from it and read in several tasks."""
    path = f"{shared_folder(spark)}/tidewright/orders-{uuid.uuid4().hex}.xlsx"
    write_workbook(orders_daily(spark, d).select("ts", "y"), path, "ts")
    df = resolve(spark, pipeline.register_dataset(spark, path, "uploaded_orders"))
    return df.select(F.to_date("ts").alias("ts"), "y")


def csv_round_trip(spark, d):
    """A table written as CSV and read back by a schema, its columns found by their names."""
    path = f"{shared_folder(spark)}/tidewright/events-{uuid.uuid4().hex}.csv"
    rows = table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    write_csv(rows, path)
    df = load_csv(spark, path, rows.schema)
    date, target, _ = infer_columns(df, date_col="ts", strategy="name")
    return clean.preprocess(df, date, target, "event_type", "event_id").groupBy("series_id").agg(F.count("*").alias("n"), F.round(F.sum(F.round("y", 2).cast("decimal(18,2)")).cast("double"), 2).alias("total"))


def catalogue_versions(spark, d):
    """Two versions of a durable dataset, read by name and by number."""
    store = Catalogue(spark)
    name = f"events-{uuid.uuid4().hex}"
    e = table(spark, d, "events")
    store.put(name, e.where("event_id % 2 = 0"), expected=0)
    store.put(name, e, expected=1)
    count = lambda v, df: df.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("version", F.lit(v))
    return count(1, store.get(name, 1)).unionByName(count(2, store.get(name)))


def future_calendar(spark, d):
    """Calendar features of the days after each series' last one."""
    last = orders_by_priority(spark, d).groupBy("series_id").agg(F.max("ts").alias("last_ts")).withColumn("frequency", F.lit("D"))
    out = future_features(last, HORIZON)
    return out.select("series_id", "h", "ds", "year", "month", "quarter", "week", "dayofweek", "is_weekend", "days_in_month", "day_of_year", *_r("sin_week", "cos_month", digits=6))


#: Tables that the service queries serve as datasets.
SERVED = ("events", "lineitem", "orders")

QUERIES = {
    f.__name__: f
    for f in (
        series_build, series_by_region, coerce_clean, cleaning_log, dedup_keep_last, min_history, freq_detect, quality_report, calendar, lags, rolling, momentum,
        feature_frame, differences, rolling_band, preprocess_summary, summary_stats, trend_ols, volatility, histogram, seasonal_strength, seasonality_detect,
        periodicity, decomposition_summary, iqr_anomalies, rolling_mad, anomaly_digest, folds, naive_forecasts, seasonal_naive_forecasts, metrics_by_fold,
        leaderboard, mase, holdout_mae, horizon_dates, gaussian_band, band_annotation, expected_change, horizon_means, residual_diagnostics, hw_fixed_params,
        drivers, structured_summary, brief_text, append_forecast, model_catalog, event_buckets, ets_backtest, arima_backtest, gbt_backtest,
        all_models_leaderboard, feature_importance, feature_attribution, empirical_band, sample_generator, full_pipeline, column_inference, dataset_catalog,
        service_validate, service_explore, service_train, service_evaluate, service_forecast, service_explain, service_recommend, service_upload, summary_numbers,
        csv_round_trip, catalogue_versions, future_calendar, long_rolling, long_features, long_rolling_mad, long_quantiles, long_summary, long_iqr,
    )
} | {"decompose_p7": _decomposed(7), "decompose_p30": _decomposed(30)}

"""Descriptive statistics, trend, volatility, decomposition, seasonality and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.stats import t_p_value
from ..series import by_time, whole_series, with_position
from . import halo
from .features import trailing
from .quantiles import exact_quantiles
from .validate import iqr_bounds, is_outlier

# Seasons looked for by frequency, in order; the first list is the full one, the second the short profile.
SEASONS = {"D": [("weekly", 7), ("monthly", 30), ("quarterly", 91), ("yearly", 365)], "W": [("monthly", 4), ("quarterly", 13), ("yearly", 52)], "MS": [("monthly", 12), ("quarterly", 4)], "QS": [("yearly", 4)], "YS": []}
PROFILE = {"D": [("weekly", 7), ("yearly", 365)], "W": [("yearly", 52), ("monthly", 4)], "MS": [("yearly", 12), ("monthly", 12)], "QS": [("yearly", 4)]}
#: Least strength that counts as a season.
STRENGTH = 0.10
NO_SEASON = "no strong season was found"
#: Scale from the median absolute deviation to a standard deviation.
MAD = 1.4826


def summary_stats(series: DataFrame, bounded: bool = False) -> DataFrame:
    """min, max, mean, median, std, first, recent and the latest change in per cent.

    bounded: for series of any length.  The median comes by exact_quantiles and the value before the last by a second maximum,
    so no task holds the values of a series.
    """
    shared = [F.min("y").alias("min"), F.max("y").alias("max"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), F.min_by("y", "ts").alias("first"), F.max_by("y", "ts").alias("recent")]
    if bounded:
        last = series.groupBy("series_id").agg(F.max("ts").alias("_last"))
        before = series.join(last, "series_id").where("ts < _last").groupBy("series_id").agg(F.max_by("y", "ts").alias("before"))
        median = exact_quantiles(series, [0.5]).select("series_id", F.col("q")[0].alias("median"))
        out = series.groupBy("series_id").agg(*shared).join(median, "series_id", "left").join(before, "series_id", "left")
    else:
        seen = series.withColumn("prev", F.lag("y").over(by_time()))
        out = seen.groupBy("series_id").agg(*shared, F.percentile("y", 0.5).alias("median"), F.max_by("prev", "ts").alias("before"))
    change = F.when(F.col("before") != 0, F.round((F.col("recent") - F.col("before")) / F.col("before") * 100, 4))
    return out.withColumn("latest_change_pct", change).drop("before")


def trend(series: DataFrame) -> DataFrame:
    """Least-squares line over positions: slope, intercept, t statistic, p-value, slope in per cent of the mean, direction."""
    s = with_position(series).groupBy("series_id").agg(F.count("*").alias("n"), F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("intercept"), F.regr_sxx("y", "t").alias("sxx"), F.regr_syy("y", "t").alias("syy"), F.regr_sxy("y", "t").alias("sxy"), F.avg("y").alias("mean"))
    sse = F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    s = s.withColumn("sse", F.when(sse < 1e-12 * F.col("syy"), 0.0).otherwise(sse))
    s = s.withColumn("t_stat", F.when((F.col("n") > 2) & (F.col("sse") > 0), F.col("slope") / F.sqrt(F.col("sse") / (F.col("n") - 2) / F.col("sxx"))))
    s = s.withColumn("p_value", F.coalesce(t_p_value(F.col("t_stat"), (F.col("n") - 2).cast("double")), F.lit(1.0)))
    direction = F.when(F.col("p_value") > 0.05, "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    pct = F.when(F.col("mean") != 0, F.round(F.col("slope") / F.col("mean") * 100, 4))
    return s.select("series_id", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("t_stat", 4).alias("t_stat"), F.round("p_value", 4).alias("p_value"), pct.alias("slope_pct"), direction.alias("direction"))


def volatility(series: DataFrame) -> DataFrame:
    """First and last rolling standard deviation, their ratio and what it says; the window is a fifth of the series, 7 to 28.

    The first one is that of the shortest start that counts, half a window, and the last one that of the last window, so both are
    aggregates over rows chosen by place.
    """
    n = F.count("*").over(whole_series())
    own = with_position(series).withColumn("n", n).withColumn("w", F.greatest(F.lit(7), F.least(F.lit(28), F.floor(F.col("n") / 5))))
    start = F.floor(F.col("w") / 2)  # three rows at least
    enough = F.col("n") >= start
    early = F.stddev_samp(F.when(enough & (F.col("t") < start), F.col("y")))
    recent = F.stddev_samp(F.when(enough & (F.col("t") >= F.col("n") - F.col("w")), F.col("y")))
    out = own.groupBy("series_id").agg(F.count("*").alias("n"), F.stddev_samp("y").alias("overall"), early.alias("early"), recent.alias("recent"))
    ratio = F.when(F.col("early") > 0, F.col("recent") / F.col("early"))
    level = F.when(F.col("n") < 15, "unknown").when(ratio > 1.25, "increasing").when(ratio < 0.8, "decreasing").otherwise("stable")
    r4 = lambda c: F.round(c, 4)
    return out.select("series_id", r4("overall").alias("overall"), r4("recent").alias("recent"), r4("early").alias("early"), r4(ratio).alias("ratio"), level.alias("level"))


def _trends(series: DataFrame, periods: list[int], running: bool = True) -> DataFrame:
    """series with t, n, and for each period p the column trend_p: a centred moving average whose ends are filled by a line, null
    below two periods of rows.

    All averages are differences of one running sum (of what is above the mean, so it stays small), read `p // 2` rows ahead and
    behind; an even period weighs the two ends of its window by half.  The ends are filled from least-squares lines through p
    rows: the first ones with a trend, and those before the last one with a trend.  All of it shares one order of the rows.
    Without `running` each window is summed by itself: slower by its width, without the last rounding of a difference of sums.
    """
    order, whole = by_time(), whole_series()
    own = series.withColumns({"t": F.row_number().over(order) - 1, "n": F.count("*").over(whole), "_mean": F.avg("y").over(whole)})
    own = own.withColumn("_sum", F.sum(F.col("y") - F.col("_mean")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    averages = {}
    for p in periods:
        half = p // 2
        if running:
            total = F.lead("_sum", half).over(order) - F.lag("_sum", half + 1, 0.0).over(order) + F.col("_mean") * (2 * half + 1)
        else:
            total = F.sum("y").over(order.rowsBetween(-half, half))
        if p % 2 == 0:
            total = total - 0.5 * (F.lag("y", half).over(order) + F.lead("y", half).over(order))
        inside = (F.col("n") >= 2 * p) & (F.col("t") >= half) & (F.col("t") < F.col("n") - half)
        averages[f"_ma_{p}"] = F.when(inside, total / p)
    own = own.withColumns(averages)
    lines = {}
    for p in periods:
        half, ma = p // 2, F.col(f"_ma_{p}")
        back = F.col("n") - half - 1  # the last row with a trend
        for k, where in ((1, F.col("t") < half + p), (2, (F.col("t") >= back - p) & (F.col("t") < back))):
            for name, f in (("s", F.regr_slope), ("i", F.regr_intercept)):
                lines[f"_{name}{k}_{p}"] = f(F.when(where, ma), F.when(where, F.col("t"))).over(whole)
    own = own.withColumns(lines)
    fill = lambda k, p: F.col(f"_s{k}_{p}") * F.col("t") + F.col(f"_i{k}_{p}")
    trends = {f"trend_{p}": F.coalesce(f"_ma_{p}", F.when(F.col("t") < p // 2, fill(1, p)).otherwise(fill(2, p))) for p in periods}
    return own.withColumns(trends).drop("_sum", "_mean", *averages, *lines)


def decompose(series: DataFrame, period: int) -> DataFrame:
    """Additive decomposition: trend (see _trends), seasonal, resid.  Series below two periods are left out."""
    own = _trends(series, [period], running=False).where(F.col("n") >= 2 * period).withColumnRenamed(f"trend_{period}", "trend")
    slot = Window.partitionBy("series_id", F.col("t") % period)
    own = own.withColumn("_raw", F.avg(F.col("y") - F.col("trend")).over(slot))
    first = F.avg(F.when(F.col("t") < period, F.col("_raw"))).over(whole_series())  # each slot once
    own = own.withColumn("seasonal", F.col("_raw") - first)
    return own.select("series_id", "ts", "t", "y", "trend", "seasonal", (F.col("y") - F.col("trend") - F.col("seasonal")).alias("resid"))


def seasonal_strengths(series: DataFrame, candidates: list[tuple[str, int]], least: int = 2) -> DataFrame:
    """Rows series_id, name, period, place, strength for the candidates that a series has `least` periods of; one row of nulls for
    a series without any.  Strength: 1 - var(resid) / var(y), at least 0.

    All candidates are one relation: what is left of y without the trend, by season and slot of the season.  The seasonal part
    is the slot's mean, so the residuals' variance is what varies inside of the slots.  Everything is keyed by the series, so the
    exchange of the windows serves the aggregates too.
    """
    periods = sorted({p for _, p in candidates})
    own = _trends(series, periods).withColumn("_v", F.var_pop("y").over(whole_series()))
    entries = [F.when(F.col("n") >= least * p, F.struct(F.lit(name).alias("name"), F.lit(p).alias("period"), F.lit(k).alias("place"), (F.col("y") - F.col(f"trend_{p}")).alias("d"), (F.col("t") % p).alias("slot"))) for k, (name, p) in enumerate(candidates)]
    rows = own.select("series_id", "_v", F.explode_outer(F.array_compact(F.array(*entries))).alias("x")).select("series_id", "_v", "x.*")
    slots = rows.groupBy("series_id", "name", "period", "place", "slot").agg(F.count("d").alias("n"), F.var_pop("d").alias("within"), F.max("_v").alias("v"))
    parts = slots.groupBy("series_id", "name", "period", "place").agg((F.sum(F.col("within") * F.col("n")) / F.sum("n")).alias("r"), F.max("v").alias("v"))
    strength = F.when(F.col("v") > 0, F.greatest(F.lit(0.0), 1 - F.col("r") / F.col("v"))).otherwise(0.0)
    return parts.select("series_id", "name", "period", "place", F.when(F.col("name").isNotNull(), strength).alias("strength"))


def seasonal_strength(series: DataFrame, period: int) -> DataFrame:
    """series_id, period, strength of one period, for series of two periods or more."""
    return seasonal_strengths(series, [("", period)]).where("name is not null").select("series_id", "period", "strength")


def detect_seasonality(series: DataFrame, frequency: str = "D") -> DataFrame:
    """Per series: the strongest season of strength 0.1 or more, whether there is one, all such seasons (name to period and
    strength), and a note where there is none."""
    candidates = SEASONS.get(frequency, SEASONS["D"] if frequency == "IR" else [])
    if not candidates:
        return series.select("series_id").distinct().select("series_id", F.lit(False).alias("detected"), F.lit(None).cast("string").alias("seasonality_type"), F.lit(None).cast("int").alias("period"), F.lit(0.0).alias("strength"), F.expr("map_from_arrays(array(), array())").cast("map<string,struct<period:int,strength:double>>").alias("periods"), F.lit(NO_SEASON).alias("note"))
    found = seasonal_strengths(series, candidates, 3).withColumn("strength", F.round(F.least(F.col("strength"), F.lit(1.0)), 3))
    ok = F.col("name").isNotNull() & (F.col("strength") >= STRENGTH)
    best = F.max_by(F.struct("name", "period", "strength"), F.when(ok, F.struct("strength", -F.col("place"))))
    entries = F.collect_list(F.when(ok, F.struct("name", F.struct("period", "strength").alias("x"))))  # a few seasons
    out = found.groupBy("series_id").agg(best.alias("best"), F.map_from_entries(F.array_sort(entries)).alias("periods"))
    return out.select("series_id", F.col("best").isNotNull().alias("detected"), F.col("best.name").alias("seasonality_type"), F.col("best.period").alias("period"), F.coalesce("best.strength", F.lit(0.0)).alias("strength"), F.coalesce("periods", F.expr("map_from_arrays(array(), array())").cast("map<string,struct<period:int,strength:double>>")).alias("periods"), F.when(F.col("best").isNull(), NO_SEASON).alias("note"))


def detect_periodicity(series: DataFrame, frequency: str = "D") -> DataFrame:
    """The short profile: strength of each candidate and the first strictly strongest."""
    candidates = PROFILE.get(frequency, [])
    if not candidates:
        return series.select("series_id").distinct().select("series_id", F.lit(None).cast("string").alias("primary"), F.expr("map_from_arrays(array(), array())").cast("map<string,struct<period:int,strength:double>>").alias("periods"))
    found = seasonal_strengths(series, candidates, 3).where("name is not null")
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct("period", F.round("strength", 4).alias("strength"))))))
    once = found.groupBy("series_id", "name").agg(F.max_by(F.struct("period", "strength", "place"), "place").alias("x")).select("series_id", "name", "x.*")
    return once.groupBy("series_id").agg(F.max_by("name", F.struct("strength", -F.col("place"))).alias("primary"), entries.alias("periods"))


def decomposition_summary(series: DataFrame, period: int = 7) -> DataFrame:
    """Last trend value, largest seasonal swing and spread of the residuals."""
    parts = decompose(series, period)
    return parts.groupBy("series_id").agg(F.max_by("trend", "t").alias("trend_last"), F.max(F.abs("seasonal")).alias("seasonal_max"), F.stddev_pop("resid").alias("resid_std"))


def iqr_anomalies(series: DataFrame, multiple: float = 3.0, bounded: bool = False) -> DataFrame:
    """Rows with their bounds and whether they lie beyond.  bounded: see iqr_bounds."""
    return series.join(iqr_bounds(series, multiple, bounded), "series_id").withColumn("is_anomaly", is_outlier()).drop("flat")


def rolling_anomalies(series: DataFrame, window: int = 28, multiple: float = 3.0, rows: int | None = None) -> DataFrame:
    """Rows further from the rolling median than `multiple` scaled rolling median deviations.  rows: blocks of a long series."""
    least = max(7, window // 2)

    def make(df: DataFrame, order: WindowSpec) -> DataFrame:
        own = df.withColumn("med", trailing(F.percentile("y", 0.5), window, least, order=order))
        own = own.withColumn("off", F.abs(F.col("y") - F.col("med")))
        return own.withColumn("mad", trailing(F.percentile("off", 0.5), window, least, "off", order))

    own = halo.windows(series, make, 2 * (window - 1), rows=rows)
    far = F.col("off") > multiple * MAD * F.when(F.col("mad") != 0, F.col("mad"))
    return own.withColumn("is_anomaly", F.coalesce(far, F.lit(False))).drop("off")


def detect_anomalies(series: DataFrame, method: str = "iqr", multiple: float = 3.0, window: int = 28) -> DataFrame:
    if method == "iqr":
        return iqr_anomalies(series, multiple)
    if method == "rolling":
        return rolling_anomalies(series, window)
    raise ValueError(f"unknown anomaly method: {method}")


def anomaly_digest(flagged: DataFrame, method: str = "iqr_x3.0", most: int = 50) -> DataFrame:
    """Per series: how many anomalies, the method and the first dates (a report of at most `most`)."""
    hit = F.when(F.col("is_anomaly"), F.col("ts"))
    first = flagged.withColumn("_k", F.row_number().over(whole_series().orderBy(F.col("is_anomaly").desc(), "ts")))
    dates = F.array_sort(F.collect_list(F.when(F.col("_k") <= most, hit)))
    return first.groupBy("series_id").agg(F.count_if("is_anomaly").alias("count"), F.lit(method).alias("method"), dates.alias("dates"))


def histogram(series: DataFrame, bins: int = 40) -> DataFrame:
    """Counts of values in equal bins from the least to the largest value."""
    ends = series.groupBy("series_id").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("y") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return series.join(ends, "series_id").groupBy("series_id", bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def explore(spark: SparkSession, series: DataFrame, frequency: str = "D") -> DataFrame:
    """The whole exploration as one nested row per series."""
    wrap = lambda df, name: df.select("series_id", F.struct(*[c for c in df.columns if c != "series_id"]).alias(name))
    out = wrap(summary_stats(series), "summary_stats")
    parts = {"trend": trend(series), "volatility": volatility(series), "seasonality": detect_seasonality(series, frequency), "periodicity": detect_periodicity(series, frequency), "anomalies": anomaly_digest(iqr_anomalies(series))}
    if frequency == "D":
        parts["decomposition"] = decomposition_summary(series, 7)
    for name, df in parts.items():
        out = out.join(wrap(df, name), "series_id", "left")
    return out

"""Frequency detection and the data-quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import by_time
from .clean import coerce, keep_last
from .quantiles import exact_quantiles

# Days between points that make a frequency, tested in this order within 15 per cent.
STEPS = [("D", 1.0), ("W", 7.0), ("MS", 30.0), ("MS", 30.5), ("QS", 90.0), ("YS", 365.0)]
TOLERANCE = 0.15
# What an issue costs on the scale of 100, and the most that a report with an error can score.
PENALTY = {"missing": 10, "duplicates": 10, "gaps": 10, "irregular": 5, "outliers": 5, "constant": 20}
ERROR_CAP = 50


def label_of(seconds: Column) -> Column:
    """The frequency label of a median step in seconds; IR where none fits."""
    days = seconds / 86_400
    out = F.lit("IR")
    for name, step in reversed(STEPS):
        out = F.when(F.abs(days - step) / step < TOLERANCE, name).otherwise(out)
    return out


def detect_frequency(series: DataFrame) -> DataFrame:
    """Per series: the median of its positive steps (whole seconds) and the frequency label."""
    gap = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(by_time()).cast("timestamp"))
    steps = series.select("series_id", gap.alias("gap"))
    median = steps.groupBy("series_id").agg(F.percentile(F.when(F.col("gap") > 0, F.col("gap")), 0.5).alias("median_seconds"))
    return median.withColumn("frequency", F.coalesce(label_of(F.col("median_seconds")), F.lit("IR")))


def iqr_bounds(series: DataFrame, multiple: float = 3.0, bounded: bool = False) -> DataFrame:
    """Per series: quartiles (linear interpolation) and the bounds beyond which a value is an outlier.

    bounded: by exact_quantiles, for series whose distinct values do not fit into one task's memory.
    """
    if bounded:
        q = exact_quantiles(series, [0.25, 0.75])
    else:
        q = series.groupBy("series_id").agg(F.percentile("y", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    iqr = F.col("q")[1] - F.col("q")[0]
    return q.select("series_id", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), (F.col("q")[0] - multiple * iqr).alias("low"), (F.col("q")[1] + multiple * iqr).alias("high"), (iqr == 0).alias("flat"))


def is_outlier() -> Column:
    return F.coalesce(~F.col("flat") & ((F.col("y") < F.col("low")) | (F.col("y") > F.col("high"))), F.lit(False))


def quality_report(df: DataFrame, date_col: str = "date", target_col: str = "target", series_col: str | None = None, seq_col: str | None = None, allow_negative: bool = True, iqr_multiple: float = 3.0) -> DataFrame:
    """One row per series: counts, frequency, coverage, score, validity and the list of issues in fixed order."""
    rows = coerce(df, date_col, target_col, series_col, seq_col)
    raw = rows.groupBy("series_id").agg(
        F.count("*").alias("rows_in"),
        F.count_if(F.col("ts").isNull()).alias("bad_dates"),
        F.count_if(F.col("ts").isNotNull()).alias("dated"),
        F.count_if(F.col("ts").isNotNull() & F.col("raw_null")).alias("missing_targets"),
        F.count_if(F.col("ts").isNotNull() & ~F.col("raw_null") & F.col("y").isNull()).alias("unparsed_targets"),
    )
    dated = keep_last(rows.where("ts is not null"))
    dates = dated.groupBy("series_id").agg(F.count("*").alias("dates"))
    series = dated.where("y is not null").select("series_id", "ts", "y")
    profile = series.groupBy("series_id").agg(
        F.count("*").alias("n"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count_if(F.col("y") < 0).alias("negatives"),
        (F.min("y") == F.max("y")).alias("constant"),
    )
    outliers = series.join(iqr_bounds(series, iqr_multiple), "series_id").groupBy("series_id").agg(F.count_if(is_outlier()).alias("outliers"))
    out = raw.join(dates, "series_id", "left").join(profile, "series_id", "left").join(outliers, "series_id", "left").join(detect_frequency(series), "series_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.withColumns({"n": zero("n"), "duplicates": F.col("dated") - zero("dates"), "negatives": zero("negatives"), "outliers": zero("outliers"), "constant": F.coalesce("constant", F.lit(False)), "frequency": F.coalesce("frequency", F.lit("IR"))})
    out = out.withColumn("coverage_days", F.when(F.col("n") > 0, F.datediff("end_ts", "start_ts") + 1).otherwise(0))
    gaps = (F.col("frequency") == "D") & (F.col("n") < 0.95 * F.col("coverage_days"))
    out = out.withColumn("missing_days", F.when(gaps, F.col("coverage_days") - F.col("n")).otherwise(0))
    issue = lambda cond, severity, category, text: F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), text.alias("message")))
    says = F.format_string
    empty = F.col("n") == 0
    negative = F.lit(not allow_negative) & (F.col("negatives") > 0)
    issues = F.array_compact(
        F.array(
            issue(F.col("bad_dates") > 0, "warning", "dates", says("%d rows have invalid dates", "bad_dates")),
            issue(empty, "error", "empty", F.lit("no rows are left after cleaning")),
            issue(F.col("duplicates") > 0, "warning", "duplicates", says("%d duplicate dates", "duplicates")),
            issue(F.col("missing_targets") + F.col("unparsed_targets") > 0, "warning", "missing", says("%d missing target values", F.col("missing_targets") + F.col("unparsed_targets"))),
            issue(F.col("missing_days") > 0, "warning", "gaps", says("%d days are missing", "missing_days")),
            issue(~empty & (F.col("frequency") == "IR"), "warning", "frequency", F.lit("the spacing of dates is irregular")),
            issue(F.col("negatives") > 0, "error" if not allow_negative else "info", "negative", says("%d negative values", "negatives")),
            issue(F.col("outliers") > 0, "warning", "outliers", says(f"%d values beyond {iqr_multiple:g} times the interquartile range", "outliers")),
            issue(F.col("constant"), "warning", "constant", F.lit("the target is constant")),
        )
    )
    off = lambda cond, name: F.when(cond, PENALTY[name]).otherwise(0)
    score = 100 - off(F.col("missing_targets") > 0, "missing") - off(F.col("duplicates") > 0, "duplicates") - off(F.col("missing_days") > 0, "gaps") - off(F.col("frequency") == "IR", "irregular") - off(F.col("outliers") > 0, "outliers") - off(F.col("constant"), "constant")
    error = empty | negative
    score = F.when(empty, 0).when(error, F.least(F.greatest(score, F.lit(0)), F.lit(ERROR_CAP))).otherwise(F.greatest(score, F.lit(0)))
    return out.withColumns({"score": score, "is_valid": ~error, "issues": issues}).drop("dated", "dates", "median_seconds")

"""Coercion, filtering, deduplication and the cleaning log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError


def require_columns(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValidationError(f"missing required columns: {', '.join(missing)}")


def coerce(df: DataFrame, date_col: str = "date", target_col: str = "target", series_col: str | None = None, seq_col: str | None = None) -> DataFrame:
    """series_id, ts (time-zone free), y, seq, and raw_null (the target was null before coercion).

    What cannot be parsed becomes null; not-a-number and infinities count as null targets.  seq is the order of arrival,
    which decides between rows of one date; without seq_col it is the place in the scan.
    """
    require_columns(df, date_col, target_col)
    kinds = dict(df.dtypes)
    date = F.col(date_col)
    ts = F.try_to_timestamp(date) if kinds[date_col] == "string" else date
    y = F.col(target_col).try_cast("double") if kinds[target_col] == "string" else F.col(target_col).cast("double")
    y = F.when(F.isnan(y) | (F.abs(y) == float("inf")), None).otherwise(y)
    return df.select(
        (F.col(series_col).cast("string") if series_col else F.lit("all")).alias("series_id"),
        ts.cast("timestamp_ntz").alias("ts"),
        y.alias("y"),
        (F.col(seq_col) if seq_col else F.monotonically_increasing_id()).alias("seq"),
        F.col(target_col).isNull().alias("raw_null"),
    )


def keep_last(coerced: DataFrame) -> DataFrame:
    """Of the rows of one series and date, the last to arrive.  A partial aggregate, so a hot date is folded before the shuffle."""
    best = coerced.groupBy("series_id", "ts").agg(F.max_by(F.struct("y", "raw_null"), "seq").alias("x"))
    return best.select("series_id", "ts", "x.y", "x.raw_null")


def preprocess(df: DataFrame, date_col: str = "date", target_col: str = "target", series_col: str | None = None, seq_col: str | None = None, dropna_target: bool = True) -> DataFrame:
    """The cleaned series: valid dates, one row per date (the last), numeric targets."""
    rows = coerce(df, date_col, target_col, series_col, seq_col).where("ts is not null")
    out = keep_last(rows)
    return (out.where("y is not null") if dropna_target else out).select("series_id", "ts", "y")


def cleaning_log(df: DataFrame, date_col: str = "date", target_col: str = "target", series_col: str | None = None) -> DataFrame:
    """Per series: counts of what cleaning removes and the list of applied steps."""
    rows = coerce(df, date_col, target_col, series_col)
    counts = rows.groupBy("series_id", "ts").agg(F.count("*").alias("n"), F.max_by("y", "seq").alias("y"))
    sums = counts.groupBy("series_id").agg(
        F.sum("n").alias("rows_in"),
        F.sum(F.when(F.col("ts").isNull(), F.col("n")).otherwise(0)).alias("bad_dates"),
        F.sum(F.when(F.col("ts").isNotNull(), F.col("n") - 1).otherwise(0)).alias("duplicates"),
        F.count_if(F.col("ts").isNotNull() & F.col("y").isNull()).alias("null_targets"),
    )
    said = lambda text, c: F.when(F.col(c) > 0, F.format_string(text, c))
    steps = F.array_compact(F.array(said("dropped %d rows with invalid dates", "bad_dates"), F.lit("sorted by date"), said("removed %d duplicate dates, kept the last", "duplicates"), said("dropped %d rows with missing targets", "null_targets")))
    return sums.withColumn("rows_out", F.col("rows_in") - F.col("bad_dates") - F.col("duplicates") - F.col("null_targets")).withColumn("transformations", steps)


def summary(series: DataFrame) -> DataFrame:
    """Per series: n, start, end, mean, std (sample), min, max, recent."""
    return series.groupBy("series_id").agg(
        F.count("*").alias("n"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.avg("y").alias("mean"),
        F.stddev_samp("y").alias("std"),
        F.min("y").alias("min"),
        F.max("y").alias("max"),
        F.max_by("y", "ts").alias("recent"),
    )

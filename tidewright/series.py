"""The canonical relation series_id, ts, y (and position t), for any number of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_time() -> WindowSpec:
    """Order within a series.  All algorithms are positional: gaps in time are not filled."""
    return Window.partitionBy("series_id").orderBy("ts")


def whole_series() -> WindowSpec:
    return Window.partitionBy("series_id")


def to_series(df: DataFrame, ts: Column, value: Column, series_id: Column | None = None) -> DataFrame:
    """Aggregate rows to one value per series and time; money is summed as decimals, so results do not depend on order."""
    keyed = df.select((series_id if series_id is not None else F.lit("all")).cast("string").alias("series_id"), ts.alias("ts"), value.alias("v"))
    return keyed.groupBy("series_id", "ts").agg(F.sum("v").cast("double").alias("y"))


def with_position(series: DataFrame) -> DataFrame:
    """Adds t, the place of a row in its series, from 0."""
    return series.withColumn("t", F.row_number().over(by_time()) - 1)


def at_least(series: DataFrame, rows: int) -> DataFrame:
    """Series with at least that many rows (the minimum-history guard; others are left out, not raised)."""
    return series.withColumn("_n", F.count("*").over(whole_series())).where(F.col("_n") >= rows).drop("_n")


def short_series(series: DataFrame, rows: int) -> DataFrame:
    """Series that the guard leaves out: series_id, n, reason."""
    counts = series.groupBy("series_id").agg(F.count("*").alias("n")).where(F.col("n") < rows)
    return counts.withColumn("reason", F.format_string(f"needs at least {rows} rows, has %d", "n"))

"""Calendar scalars, frequency constants and the horizon grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lags and windows by frequency label; None stands for any other label.
LAGS = {
    "D": [1, 2, 3, 7, 14, 28, 30, 90, 365],
    "W": [1, 2, 4, 8, 12, 26, 52],
    "MS": [1, 2, 3, 6, 12],
    "M": [1, 2, 3, 6, 12],
    "QS": [1, 2, 4],
    "Q": [1, 2, 4],
    "YS": [1],
    "A": [1],
    "Y": [1],
    None: [1, 2, 3],
}
WINDOWS = {"D": [7, 14, 28, 90], "W": [4, 8, 13, 26], "MS": [3, 6, 12], "QS": [2, 4], "YS": [2, 3], None: [3, 7]}
TREE_WINDOWS = {"D": [7, 14, 28], "W": [4, 13, 26], "MS": [3, 6, 12], "QS": [2, 4], None: [7, 28]}
ALIASES = {"W-SUN": "W", "W-MON": "W", "M": "MS", "Q": "QS", "A": "YS", "Y": "YS"}


def label(frequency: str | None) -> str | None:
    """A frequency label without its aliases."""
    return ALIASES.get(frequency, frequency)


def _by(table: dict, frequency: str | None) -> list[int]:
    return list(table.get(frequency, table.get(label(frequency), table[None])))


def default_lags(frequency: str | None) -> list[int]:
    return _by(LAGS, frequency)


def default_windows(frequency: str | None) -> list[int]:
    return _by(WINDOWS, frequency)


def tree_windows(frequency: str | None) -> list[int]:
    """Windows of the boosted-tree model."""
    return _by(TREE_WINDOWS, frequency)


def calendar_columns(ts: Column) -> dict[str, Column]:
    """Name to expression of the twenty calendar features; all stay inside code generation."""
    weekday = F.weekday(ts)
    month, day = F.month(ts), F.dayofmonth(ts)
    turn = lambda f, x, period: f(2 * F.pi() * x / period)
    return {
        "year": F.year(ts),
        "month": month,
        "quarter": F.quarter(ts),
        "week": F.weekofyear(ts),
        "dayofweek": weekday,
        "dayofmonth": day,
        "iso_year": F.extract(F.lit("YEAROFWEEK"), ts),
        "iso_weekday": weekday + 1,
        "sin_month": turn(F.sin, month, 12),
        "cos_month": turn(F.cos, month, 12),
        "sin_week": turn(F.sin, weekday, 7),
        "cos_week": turn(F.cos, weekday, 7),
        "sin_dayofmonth": turn(F.sin, day, 31),
        "cos_dayofmonth": turn(F.cos, day, 31),
        "is_weekend": (weekday >= 5).cast("int"),
        "is_month_start": (day == 1).cast("int"),
        "is_month_end": (day >= 28).cast("int"),
        "days_in_month": F.dayofmonth(F.last_day(ts)),
        "day_of_year": F.dayofyear(ts),
        "week_of_year": F.weekofyear(ts),
    }


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns(calendar_columns(F.col(ts)))


def step(last: Column, h: Column, frequency: Column) -> Column:
    """The h-th date after `last`: a day or a week on, or the h-th next start of a month, quarter or year."""
    day = F.to_date(last)
    month = F.trunc(day, "month")
    quarter, year = F.trunc(day, "quarter"), F.trunc(day, "year")
    return (
        F.when(frequency == "W", F.date_add(day, (7 * h).cast("int")))
        .when(frequency.isin("MS", "M"), F.add_months(month, h))
        .when(frequency.isin("QS", "Q"), F.add_months(quarter, (3 * h).cast("int")))
        .when(frequency.isin("YS", "A", "Y"), F.add_months(year, (12 * h).cast("int")))
        .otherwise(F.date_add(day, h.cast("int")))
    )


def future_dates(last: DataFrame, horizon: int, last_col: str = "last_ts", frequency_col: str = "frequency") -> DataFrame:
    """One row per step h = 1..horizon with its date ds, for each row of `last`."""
    grid = last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return grid.withColumn("ds", step(F.col(last_col), F.col("h"), F.col(frequency_col)))


def future_features(last: DataFrame, horizon: int) -> DataFrame:
    """Calendar features on the horizon grid."""
    return calendar_features(future_dates(last, horizon), "ds")

"""Windows over series of any length: blocks of rows that carry the rows before them.

A plain window by series is one task a series.  Here rows are dealt by ranges of (series, time), so one series may fill many
tasks; their places in the series come from prefix sums over the ranges' counts.  Blocks of `rows` places are then cut at
exact places, each with the `before` (and `after`) rows of its neighbours, so a window that looks no further than that gives
in every block what it gives in the whole series.  A task holds one block and its halo.

Two rows of a series must not share a time (to_series and clean.preprocess see to that).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..series import by_time
from ..storage import stored

#: Rows of a block.
BLOCK = 1 << 18


def number_rows(series: DataFrame, ranges: int | None = None) -> DataFrame:
    """series with t, the place of a row in its series from 0.  The result is a stored table joined to one row a range and series.

    Within a range the rows are sorted and numbered by Spark in their order; what the ranges before hold of the series is
    added.  ranges: how many (default: twice the shuffle partitions).
    """
    spark = series.sparkSession
    ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = series.repartitionByRange(ranges, "series_id", "ts").sortWithinPartitions("series_id", "ts")
    placed = stored(ordered.withColumn("_row", F.monotonically_increasing_id()), "ordered").withColumn("_range", F.shiftright("_row", 33))
    held = placed.groupBy("series_id", "_range").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("series_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stored(held.select("series_id", "_range", (F.coalesce(upto, F.lit(0)) - F.col("_first")).alias("_shift")), "offsets")  # windows over ranges, not rows
    same = placed["series_id"].eqNullSafe(offsets["series_id"]) & (placed["_range"] == offsets["_range"])
    return placed.join(offsets, same).select(*[placed[c] for c in series.columns], (F.col("_row") + F.col("_shift")).alias("t"))


def in_blocks(numbered: DataFrame, before: int, after: int = 0, rows: int = BLOCK) -> DataFrame:
    """numbered with _block, and _home: whether the row belongs to it; a row is repeated for each block whose halo it is in."""
    at = F.floor(F.col("t") / rows)
    reach = F.sequence(F.greatest(F.floor((F.col("t") - after) / rows), F.lit(0)), F.floor((F.col("t") + before) / rows))
    return numbered.withColumn("_block", F.explode(reach)).withColumn("_home", F.col("_block") == at)


def windows(series: DataFrame, make: Callable[[DataFrame, WindowSpec], DataFrame], before: int, after: int = 0, rows: int | None = None) -> DataFrame:
    """make(df, window), where the window orders the rows of a series by time: of the whole series, or with `rows` given of
    blocks of so many rows.  make must not look further back than `before` rows, nor further on than `after`."""
    if rows is None:
        return make(series, by_time())
    if rows < 1:
        raise ValueError("a block needs a row at least")
    order = Window.partitionBy("series_id", "_block").orderBy("t")
    made = make(in_blocks(number_rows(series), before, after, rows), order)
    return made.where("_home").drop("_block", "_home", "t")

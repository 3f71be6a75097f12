"""Exact quantiles of many groups at once, in memory that does not grow with a group.

Each wanted order statistic of a group is a row (group, place, low, high, rank): it is the rank-th of the values from low to
high.  A round counts those values in bins, folded before the exchange, and narrows every row to the least and largest value
of the bin that holds its rank.  Rows with low = high are done.  Bins are equal steps, or equal steps of the logarithm where
the ends differ by orders of magnitude; ends of different sign are parted at zero first.  Both maps are monotone in floating
point, so a value never lands in a bin out of order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

BINS = 256
#: Ratio of the ends from which bins are steps of the logarithm.
WIDE = 1e4
#: Open rows up to which they are broadcast; beyond it, rows meet them by group and salt.
MOST_BROADCAST, SALTS = 50_000, 32
ROUNDS = 400


def _bin(y: Column, low: Column, high: Column, bins: int) -> Column:
    inf = float("inf")
    signed = F.when(y == -inf, 0).when(y < 0, 1).when(y == 0, 2).when(y < inf, 3).otherwise(4)
    step = lambda v, a, b: F.least(F.floor((v - a) / (b - a) * bins), F.lit(bins - 1)).cast("int")
    rising = F.when(high > low * WIDE, step(F.log(y), F.log(low), F.log(high))).otherwise(step(y, low, high))
    falling = bins - 1 - F.when(low < high * WIDE, step(F.log(-y), F.log(-high), F.log(-low))).otherwise(step(-y, -high, -low))
    return F.when((low <= 0) & (high >= 0) | (low == -inf) | (high == inf), signed).when(low > 0, rising).otherwise(falling)


def order_statistics(values: DataFrame, places: DataFrame, key: str = "series_id", y: str = "y", bins: int = BINS) -> DataFrame:
    """places (key, place from 0) with value: the value of that place among the key's values in order.

    Values are not null and not NaN.  They are scanned once a round (three or four rounds as a rule), so give a stored table.
    """
    own = values.select(key, F.col(y).cast("double").alias("_y")).where(F.col("_y").isNotNull() & ~F.isnan("_y"))
    ends = own.groupBy(key).agg(F.min("_y").alias("low"), F.max("_y").alias("high"))
    state = stored(places.select(key, "place").join(ends, key).withColumn("rank", F.col("place").cast("long")), "places")
    done = None
    for _ in range(ROUNDS):
        closed, open_ = state.where("low = high").select(key, "place", F.col("low").alias("value")), state.where("low < high")
        done = closed if done is None else done.unionByName(closed)
        left = open_.count()
        if not left:
            return done
        if left <= MOST_BROADCAST:
            met = own.join(F.broadcast(open_), key)
        else:  # a group of a third of all rows is spread over SALTS tasks
            salted = own.withColumn("_salt", F.pmod(F.xxhash64("_y"), F.lit(SALTS)))
            met = salted.join(open_.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [key, "_salt"])
        met = met.where((F.col("_y") >= F.col("low")) & (F.col("_y") <= F.col("high")))
        binned = met.groupBy(key, "place", "rank", _bin(F.col("_y"), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count("*").alias("n"), F.min("_y").alias("low"), F.max("_y").alias("high"))
        listed = binned.groupBy(key, "place", "rank").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "low", "high"))).alias("all"))  # a row a bin

        def step(s: Column, x: Column) -> Column:
            here = s["left"].between(0, x["n"] - 1) & s["low"].isNull()
            take = lambda name: F.when(here, x[name]).otherwise(s[name]).alias(name)
            return F.struct((s["left"] - F.when(s["low"].isNull() & ~here, x["n"]).otherwise(0)).alias("left"), take("low"), take("high"))

        zero = F.struct(F.col("rank").alias("left"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
        state = stored(listed.select(key, "place", F.aggregate("all", zero, step).alias("s")).select(key, "place", "s.low", "s.high", F.col("s.left").alias("rank")), "places")
    raise RuntimeError("quantiles did not settle")


def exact_quantiles(values: DataFrame, probabilities: Sequence[float], key: str = "series_id", y: str = "y", bins: int = BINS) -> DataFrame:
    """key, n, q: the quantiles in the order asked for, with linear interpolation between neighbours.  Keys without values are left out."""
    if not probabilities or not all(0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities must be from 0 to 1")
    fine = values.where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))
    n = stored(fine.groupBy(key).agg(F.count("*").alias("n")), "counts")
    at = n.select(key, "n", F.posexplode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("i", "p")).withColumn("at", (F.col("n") - 1) * F.col("p"))
    at = at.select(key, "n", "i", "at", F.floor("at").alias("below"), F.ceil("at").alias("above"))
    places = at.select(key, F.explode(F.array("below", "above")).alias("place")).distinct()
    found = order_statistics(fine, places, key, y, bins)
    low = found.select(key, F.col("place").alias("below"), F.col("value").alias("a"))
    high = found.select(key, F.col("place").alias("above"), F.col("value").alias("b"))
    both = at.join(low, [key, "below"]).join(high, [key, "above"])
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.col("below")))
    listed = both.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))).alias("q"))
    return listed.select(key, "n", F.transform("q", lambda x: x["v"]).alias("q"))

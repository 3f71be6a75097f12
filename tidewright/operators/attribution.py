"""Exact Shapley values of boosted trees, from a table of leaf paths.

The value of a set of features is what the trees answer when only these are known, the others being averaged by how many rows of
the training data go each way.  A tree is the sum of its leaves, and a leaf asks for at most as many features as the tree is deep,
so all sets of them can be summed: for each leaf and each pattern of its conditions that hold, the shares of its features are
worked out once.  A row then meets every leaf of its series by a join, looks its pattern up, and a row's values are the sums by
feature.  Values and the expected answer add up to the prediction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import with_position
from ..storage import stored
from . import fitting
from .backtest import MIN_TREES

#: Rows of a series that are explained, the last ones, and features that a report names.
LAST, MOST = 100, 10
_SCHEMA = "series_id string, kind string, tree int, place int, names array<string>, at array<int>, low array<int>, high array<int>, shares array<double>, bins array<int>, expected double, predicted double"


def shares_of(value: float, known: list[float]) -> np.ndarray:
    """(patterns x features): of a leaf's value, the Shapley values for each pattern of conditions that hold (bit k: condition k).

    known: the share of training rows that a condition lets through, a condition a feature.
    """
    d = len(known)
    holds = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float)
    out = np.zeros((1 << d, d))
    weights = np.array([math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)])
    for f in range(d):
        sums = np.zeros((1 << d, d))  # by size of the set: products over the other features, known or averaged
        sums[:, 0] = 1.0
        for g in range(d):
            if g != f:
                sums[:, 1:] = sums[:, 1:] * known[g] + sums[:, :-1] * holds[:, g : g + 1]
                sums[:, 0] *= known[g]
        out[:, f] = value * (holds[:, f] - known[f]) * (sums @ weights)
    return out


def leaf_paths(model: fitting.Boosted) -> Iterator[tuple[int, int, float, dict[int, tuple[int, int, float]]]]:
    """(tree, leaf, value, feature -> (low, high, share)): low < bin <= high is what a leaf asks of a feature."""
    for t, ((feature, cut, value), reached) in enumerate(zip(model.trees, model.reached)):
        size = 1 << model.depth
        rows = np.zeros(2 * size - 1)
        rows[size - 1 :] = reached
        for node in range(size - 2, -1, -1):
            rows[node] = rows[2 * node + 1] + rows[2 * node + 2]
        for leaf in range(size):
            node, asked, real = 0, {}, True
            for level in range(model.depth - 1, -1, -1):
                right = leaf >> level & 1
                child, f = 2 * node + 1 + right, int(feature[node])
                if f >= 0:
                    low, high, share = asked.get(f, (-1, 1 << 30, 1.0))
                    part = rows[child] / rows[node] if rows[node] else 0.5
                    asked[f] = (max(low, int(cut[node])), high, share * part) if right else (low, min(high, int(cut[node])), share * part)
                elif right:  # a node without a split sends all to the left
                    real = False
                    break
                node = child
            if real and value[leaf]:
                yield t, leaf, float(value[leaf]), asked


def _tables(part: pd.DataFrame, frequency: str, n_trees: int, last: int) -> Iterator[dict]:
    part = part.sort_values("t")
    own = fitting.tree_fit(part["y"].to_numpy(float), part["ts"].to_numpy("datetime64[ns]"), frequency, n_trees)
    expected = own.mean + own.std * own.model.base
    for tree, leaf, value, asked in leaf_paths(own.model):
        known = [s for _, _, s in asked.values()]
        expected += own.std * value * math.prod(known)
        if asked:
            yield {"kind": "leaf", "tree": tree, "place": leaf, "names": [own.names[f] for f in asked], "at": list(asked), "low": [a for a, _, _ in asked.values()], "high": [b for _, b, _ in asked.values()], "shares": shares_of(own.std * value, known).ravel()}
    x = own.x[-last:]
    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(own.model.edges)], axis=1)
    for place, row in enumerate(bins):
        yield {"kind": "row", "place": place, "bins": row, "expected": expected, "predicted": own.mean + own.std * own.model.predict(x[place])}


def attributions(series: DataFrame, frequency: str = "D", n_trees: int = 300, last: int = LAST) -> DataFrame:
    """series_id, place, feature, value, expected, predicted: for the last rows with all features (place from 0, the oldest first),
    what each feature adds to the expected answer.  Series of fewer than 40 rows are left out, and so are features that no tree asks for."""
    long = series.groupBy("series_id").count().where(F.col("count") >= MIN_TREES).select("series_id")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        try:
            made = list(_tables(part, frequency, n_trees, last))
        except ValueError:  # too few complete rows
            made = []
        out = pd.DataFrame(made, columns=[c.split()[0] for c in _SCHEMA.split(", ")[1:]])
        out[["tree", "place"]] = out[["tree", "place"]].astype("Int32")
        for c in ("names", "at", "low", "high", "shares", "bins"):
            out[c] = out[c].map(lambda v: v if isinstance(v, (list, np.ndarray)) else None).astype(object)
        return out.assign(series_id=part["series_id"].iloc[0])[["series_id", *out.columns]]

    tables = stored(with_position(series).join(long, "series_id").groupBy("series_id").applyInPandas(fit, _SCHEMA), "trees")
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = tables.where("kind = 'leaf'").select("series_id", "tree", "names", "at", "low", "high", "shares").repartition(tasks, "series_id", "tree")
    rows = tables.where("kind = 'row'").select("series_id", "place", "bins", "expected", "predicted")
    met = leaves.join(rows, "series_id")
    holds = F.transform("at", lambda f, i: F.get(F.col("bins"), f).between(F.get(F.col("low"), i) + 1, F.get(F.col("high"), i)).cast("int") * F.pow(F.lit(2.0), i).cast("int"))
    met = met.withColumn("pattern", F.aggregate(holds, F.lit(0), lambda a, x: a + x))
    own = F.slice("shares", F.col("pattern") * F.size("at") + 1, F.size("at"))
    each = met.select("series_id", "place", "expected", "predicted", F.explode(F.arrays_zip(F.col("names").alias("feature"), own.alias("value"))).alias("x"))
    return each.groupBy("series_id", "place", F.col("x")["feature"].alias("feature")).agg(F.sum(F.col("x")["value"]).alias("value"), F.first("expected").alias("expected"), F.first("predicted").alias("predicted"))


def top_attributions(values: DataFrame, most: int = MOST) -> DataFrame:
    """The `most` features of the greatest mean absolute value of each series (a top-k report): series_id, feature, mean_abs_shap, rank."""
    counts = values.groupBy("series_id").agg(F.count_distinct("place").alias("rows"))
    means = values.groupBy("series_id", "feature").agg(F.sum(F.abs("value")).alias("total")).join(counts, "series_id")
    out = means.select("series_id", "feature", F.round(F.col("total") / F.col("rows"), 4).alias("mean_abs_shap"))
    return out.selectExpr("*", "row_number() over (partition by series_id order by mean_abs_shap desc, feature) as rank").where(F.col("rank") <= most)

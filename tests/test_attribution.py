"""Shapley values of trees against sums over all sets of features."""

import itertools
import math

import numpy as np
import pytest

from helpers import dates, linear, rows, series
from tidewright.operators import attribution, fitting


def answer(model, bins, known):
    """What the trees answer when only some features are known: both ways of a split on another, weighted by training rows."""
    total = model.base
    for (feature, cut, value), reached in zip(model.trees, model.reached):
        size = 1 << model.depth
        count = np.zeros(2 * size - 1)
        count[size - 1 :] = reached
        for node in range(size - 2, -1, -1):
            count[node] = count[2 * node + 1] + count[2 * node + 2]

        def walk(node):
            if node >= size - 1:
                return value[node - size + 1]
            f = feature[node]
            if f < 0:
                return walk(2 * node + 1)
            if f in known:
                return walk(2 * node + 1 + int(bins[f] > cut[node]))
            share = count[2 * node + 1] / count[node] if count[node] else 0.5
            return share * walk(2 * node + 1) + (1 - share) * walk(2 * node + 2)

        total += walk(0)
    return total


@pytest.mark.parametrize("depth", [1, 3, 4])
def test_leaf_paths_give_shapley_values(depth):
    rng = np.random.default_rng(depth)
    x = rng.integers(0, 6, (200, 4)).astype(float)
    y = x[:, 0] * 2 + x[:, 1] * x[:, 2] + rng.normal(0, 0.5, 200)
    model = fitting.Boosted(n_trees=6, rate=0.3, depth=depth).fit(x, y)
    for row in x[:5]:
        bins = [int(np.searchsorted(e, v, "left")) for e, v in zip(model.edges, row)]
        got = np.zeros(4)
        for _, _, value, asked in attribution.leaf_paths(model):
            pattern = sum(1 << k for k, (f, (low, high, _)) in enumerate(asked.items()) if low < bins[f] <= high)
            for f, v in zip(asked, attribution.shares_of(value, [s for _, _, s in asked.values()])[pattern]):
                got[f] += v
        want = np.zeros(4)
        for f in range(4):
            others = [g for g in range(4) if g != f]
            for k in range(4):
                for s in itertools.combinations(others, k):
                    want[f] += math.factorial(k) * math.factorial(3 - k) / 24 * (answer(model, bins, {*s, f}) - answer(model, bins, {*s}))
        assert np.allclose(got, want, atol=1e-10)
        assert math.isclose(answer(model, bins, set()) + got.sum(), model.predict(row), abs_tol=1e-9)


def test_values_add_up_to_the_prediction(spark):
    df = series(spark, linear(160, season=20.0)).unionByName(series(spark, linear(90, seed=3), "b")).unionByName(series(spark, linear(20), "short"))
    out = rows(attribution.attributions(df, n_trees=15, last=12))
    assert {r["series_id"] for r in out} == {"a", "b"}
    for name in "ab":
        for place in range(12):
            own = [r for r in out if (r["series_id"], r["place"]) == (name, place)]
            assert own and math.isclose(own[0]["expected"] + sum(r["value"] for r in own), own[0]["predicted"], rel_tol=1e-9)
    y = linear(160, season=20.0)
    fitted = fitting.tree_fit(y, np.array(dates(160), "datetime64[D]").astype("datetime64[ns]"), "D", 15)
    last = [r["predicted"] for r in out if r["series_id"] == "a" and r["place"] == 11]
    assert math.isclose(last[0], fitted.mean + fitted.std * fitted.model.predict(fitted.x[-1]), rel_tol=1e-9)


def test_top_features(spark):
    values = spark.createDataFrame([("a", p, f, v) for p in (0, 1) for f, v in (("x", -2.0), ("y", 1.0 + p), ("z", 0.5))] + [("a", 0, "w", 5.0)], "series_id string, place int, feature string, value double")
    assert [(r["feature"], r["mean_abs_shap"], r["rank"]) for r in rows(attribution.top_attributions(values, 3), "rank")] == [("w", 2.5, 1), ("x", 2.0, 2), ("y", 1.5, 3)]

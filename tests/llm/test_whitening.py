"""Whitening against numpy on all rows at once."""

import math

import numpy as np
import pytest

from tidewright.llm import queries, whitening

DATA = "/root/testdata/sf0.001"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(k, None if v is None else [None if c is None else float(c) for c in v]) for k, v in rows], "vec_id long, embedding array<double>").repartition(parts)


def expected(c, most=8):
    x = np.floor(1024 * np.asarray(c, float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(0)
    y = x - total / n
    cov = y.T @ y / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, total)) for r in x], y @ v / np.sqrt(e), e / np.trace(cov)


def check(out, ids, c, most=8):
    deviation, w, share = expected(c, most)
    got = {(r["vec_id"], r["component"]): r for r in out}
    assert len(got) == len(out) == len(ids) * min(most, len(c[0]))
    for k in range(min(most, len(c[0]))):
        mine = np.array([got[i, k + 1]["whitened"] for i in ids])
        sign = np.sign(mine @ w[:, k])
        assert np.abs(mine * sign - w[:, k]).max() < 1e-8
        assert all(math.isclose(got[i, k + 1]["explained"], share[k], rel_tol=1e-9) for i in ids)
    assert [int(got[i, 1]["deviation"]) for i in ids] == deviation
    assert {r["n"] for r in out} == {len(ids)} and len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-8


@pytest.mark.parametrize("parts", [1, 40])
def test_equals_one_decomposition(spark, parts, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    rng = np.random.default_rng(5)
    c = rng.normal(0, 0.3, (300, 12)) * np.linspace(1, 3, 12) + 5
    check(whitening.whiten(table(spark, enumerate(c), parts)).collect(), range(300), c)


def test_query(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    check(queries.op11_whitening(spark, DATA).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_merge_keeps_every_dimension():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 10**6, (90, 7))
    parts = [whitening.State.of(p) for p in np.split(x, [1, 4, 30, 60])]  # of one and three rows too: fewer than dimensions
    state = parts[0]
    for p in parts[1:]:
        state = state.merge(p)
    y = x - x.mean(0)
    assert state.n == 90 and [int(t) for t in state.total] == x.sum(0).tolist()
    assert np.allclose(state.v.T @ np.diag(state.s**2) @ state.v, y.T @ y, rtol=1e-11)
    assert np.allclose(state.s, np.linalg.svd(y)[1], rtol=1e-11)


def test_odd_vectors(spark):
    rows = [(1, [0.1, 0.2]), (2, None), (3, [0.3, None]), (4, [float("nan"), 1]), (5, [float("inf"), 1]), (6, []), (7, [1e300, 0]), (1, [0.1, 0.2]), (8, [0.4, 0.1]), (9, [0.2, -0.5]), (None, [0.7, 0.7]), (10, [1.0, 2.0, 3.0])]
    out = whitening.whiten(table(spark, rows)).collect()
    two = [r for r in out if r["vec_id"] != 10]
    assert sorted((r["vec_id"] or 0, r["component"]) for r in two) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (8, 1), (8, 2), (9, 1), (9, 2)]
    assert {r["n"] for r in two} == {5} and all(abs(r["whitened"]) < 3 for r in two)
    alone = [r for r in out if r["vec_id"] == 10]
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(k, 1, 0, None, 0.0, None) for k in (1, 2, 3)]
    assert whitening.whiten(table(spark, [])).collect() == [] and whitening.whiten(table(spark, [(1, None)])).collect() == []


def test_flat_dimension_and_clashing_columns(spark):
    rng = np.random.default_rng(1)
    c = np.c_[rng.normal(0, 1, 50), np.full(50, 0.25), rng.normal(0, 2, 50)]
    df = table(spark, enumerate(c)).selectExpr("*", "1 as dim", "'x' as x", "2 as n", "3 as deviation")
    out = whitening.whiten(df).collect()
    assert len(out) == 150 and all((r["whitened"] is None) == (r["component"] == 3) and (r["explained"] == 0) == (r["component"] == 3) for r in out)
    assert out[0]["identity_error"] < 1e-9


def test_large_numbers_stay_exact(spark):
    c = np.array([[3e10, 0.0], [-3e10, 1.0], [2.9e10, -3.0]])
    out = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(table(spark, enumerate(c)), most=1).collect()}
    assert [out[k] for k in range(3)] == expected(c)[0] and max(out.values()) > 1 << 63

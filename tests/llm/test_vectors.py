import numpy as np
import pytest

from tidewright.llm import vectors


def data(n=600, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 6, dim))
    x = np.concatenate([base, *(base[rng.integers(0, len(base), n // 6)] + rng.normal(0, s, (n // 6, dim)) for s in (0.02, 0.1, 0.2, 0.3)), np.repeat(base[:1], n // 6, 0) + rng.normal(0, 0.05, (n // 6, dim))])
    return x.astype(np.float32)


def brute(ids, x, labels, threshold=0.93):
    x = x.astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (u @ u.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(hit, False)
    comp = ids.copy()
    while True:
        new = np.array([min([comp[i], *comp[hit[i]]]) for i in range(len(ids))])
        if (new == comp).all():
            return hit.sum(1), comp
        comp = new


@pytest.mark.parametrize("shard", [10_000, 40])
def test_against_brute_force(spark, shard):
    x = data()
    x = np.concatenate([x, x[:30], 3 * x[:10]])  # exact copies and copies of another length
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 2, len(x))
    ids = rng.permutation(len(x)) + 10
    df = spark.createDataFrame([(int(i), [float(v) for v in r], int(k), "c") for i, r, k in zip(ids, x, labels)], "vec_id long, embedding array<float>, label int, n_links string")
    out = {r["vec_id"]: r for r in vectors.near_vectors(df, shard=shard).collect()}
    links, comp = brute(ids, x, labels)
    got = np.array([out[i]["n_links"] for i in ids])
    assert got.tolist() == links.tolist() and [out[i]["component_id"] for i in ids] == comp.tolist()
    audits = vectors.recalls(df, shard=shard).collect()
    assert all(r["recall"] == 1.0 for r in audits) and sum(r["seen"] for r in audits) > 0 and (len(audits) > 20 or shard > 40)
    assert all(out[i]["kept"] == (out[i]["component_id"] == i) for i in ids)


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], None), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [2.0, 0.0], 1), (13, [1.0, 0.0], 2), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    assert {k: out[k] for k in (1, 2, 12)} == {1: (2, 1, True), 2: (2, 1, False), 12: (2, 1, False)}
    assert all(out[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11, 13))
    assert len(out) == 14 and vectors.near_vectors(df.limit(0)).isEmpty()


def test_sparse_links_are_not_missed(spark):
    """A few near copies among many vectors: evenly spaced audits would see none of them."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    x[7:10] = x[2000:2003] + 0.05 * rng.normal(size=(3, 32))
    x[1501] = x[11]
    df = spark.createDataFrame([(k, r.tolist(), 1) for k, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    for shard in (10_000, 800):
        out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df, shard=shard).where("n_links > 0").collect()}
        assert out == {a: (1, min(p)) for p in ((7, 2000), (8, 2001), (9, 2002), (11, 1501)) for a in p}
    audits = vectors.recalls(df, shard=800).collect()
    assert sum(r["seen"] for r in audits) == 3 and all(r["recall"] == 1.0 and r["queries"] > 500 for r in audits)


def test_large_and_small_numbers(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 1.00001e200], 1), (3, [1e-200, -1e-200], 1), (4, [5e-324, -5e-324], 1), (5, [1.7e308, 1.0], 1), (6, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()}
    assert out == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5)}


def test_links_that_no_beam_reaches_are_found(monkeypatch):
    """Half of the graph is out of reach: no beam finds it, so the pair is compared exactly."""
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(2, 16)), 300, axis=0) + rng.normal(0, 0.05, (600, 16))
    near = vectors.Graph.near
    monkeypatch.setattr(vectors.Graph, "near", lambda *a: (hits := near(*a))[hits[:, 1] < 300])
    blob = vectors.build_shard(np.arange(600), np.ones(600, int), x)
    r, c, *_, recall, _ = vectors.shard_links(blob, blob, True)
    unit = vectors._unit(x)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.93, 1))
    assert set(zip(r.tolist(), c.tolist())) == set(zip(a.tolist(), b.tolist())) and len(a) > 10_000 and recall < 1


def test_graph_recall():
    x = vectors._unit(data(1800, 16, 5).astype(float)).astype(np.float32)
    g = vectors.Graph.build(x)
    hits = g.near(x, 0.93, 32)
    exact = (x @ x.T >= 0.93).sum()
    assert len(np.unique(hits[:, 0] * len(x) + hits[:, 1])) >= 0.99 * exact
    blob = vectors.build_shard(np.arange(len(x)), np.ones(len(x), int), x)
    assert vectors.shard_links(blob, blob, True)[5] == 1.0

"""Periodic runs against a search over all periods, on made and on whole texts."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import queries, runs

DATA = "/root/testdata/sf0.001"


def brute(words, copies=4, least=6):
    """Every stretch that agrees with itself q words on, for every q, and of equal stretches the smallest q."""
    ids = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if len(words) else np.zeros(0, int)
    best = {}
    for q in range(1, len(ids) // copies + 1):
        same = np.r_[False, ids[q:] == ids[:-q], False].astype(int)
        step = np.diff(same)
        for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
            length = int(b - a) + q
            if length >= max(least, copies * q):
                best.setdefault((int(a), length), q)
    return sorted((s, n, q) for (s, n), q in best.items())


def search(words, copies=4, least=6):
    number = {}
    ids = np.array([number.setdefault(w, len(number) + 1) for w in words], np.int64)
    return runs.batch_runs(ids, np.array([0]), np.array([len(ids)]), copies, least)[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9)), max_size=12))
def test_runs_of_small_alphabets(parts):
    words = [w for unit, times in parts for w in unit * times]
    assert search(words) == brute(words)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(4, 7), st.integers(5, 9))
def test_other_bounds(seed, copies, least):
    rng = np.random.default_rng(seed)
    words = np.concatenate([np.tile(rng.integers(0, 3, rng.integers(1, 12)), rng.integers(1, 12)) for _ in range(8)]).tolist()
    assert search(words, copies, least) == brute(words, copies, least)


def test_fibonacci_and_single_words():
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    assert search(list(b)) == brute(list(b))
    assert search(["w"] * 20_000) == [(0, 20_000, 1)]
    assert search(["a", "b"] * 5000 + ["c"]) == [(0, 10_000, 2)]


def test_several_texts_do_not_touch():
    ids = np.array([1] * 5 + [1] * 7 + [2, 3] * 4, np.int64)
    out = runs.batch_runs(ids, np.array([0, 5, 12, 20]), np.array([5, 12, 20, 20]))
    assert out == [[], [(0, 7, 1)], [(0, 8, 2)], []]


def test_bounds_are_checked(spark):
    with pytest.raises(ValueError):
        runs.periodic_runs(spark.createDataFrame([("a",)], "text string"), copies=3)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "a a a a a a b", "z"), (2, "a a a a a a b", None), (2, "a a a a a a b", None), (3, " \t\n ", "x"), (4, "a\x1cb " * 8, "x"), (5, "wörter " * 7 + "ende", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = sorted(runs.periodic_runs(df).collect(), key=lambda r: (r["doc_id"] or 0, str(r["runs"])))
    assert out[0].asDict() == {"doc_id": None, "runs": "z", "runs_": [(0, 6, 1)], "n_tokens": 7, "collapsed": "a b"}
    assert [(r["doc_id"], r["n_tokens"], r["collapsed"]) for r in out[1:]] == [(1, 0, ""), (1, 0, ""), (2, 7, "a b"), (2, 7, "a b"), (3, 0, ""), (4, 8, "a\x1cb"), (5, 8, "wörter ende")]
    assert runs.periodic_runs(df.limit(0)).collect() == []


def test_longest_and_listing(spark):
    df = spark.createDataFrame([([(5, 8, 2), (1, 8, 1), (1, 8, 2)],), ([],)], "runs array<struct<start:long,length:long,period:long>>")
    out = df.select(runs.longest(df["runs"]).alias("b"), runs.listing(df["runs"]).alias("l")).collect()
    assert tuple(out[0]["b"]) == (1, 8, 1) and out[0]["l"] == "5,8,2\n1,8,1\n1,8,2\n" and out[1]["b"] is None and out[1]["l"] == ""


def test_query_equals_brute_force(spark):
    out = {r["doc_id"]: r for r in queries.op12_runs(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(out) == len(docs)
    planted = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        n, h = len(words), zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        found = brute(words)
        drop = {i for s, k, q in found for i in range(s + q, s + k)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        r = out[d["doc_id"]]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{k},{q}\n" for s, k, q in found))
        assert r["collapsed_sha256"] == sha(" ".join(w for i, w in enumerate(words) if i not in drop))
    assert planted > 10

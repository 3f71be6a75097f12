import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewright.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest string, h int, kept string"  # with columns that clash with the operator's own
TEXTS = [None, "", "Same Text", "same text", "SAME TEXT", "É", "é", "x" * 200_000, "X" * 200_000, "other", " same text"] + [f"t{k % 40}" for k in range(200)]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(k, t, "d", 1, "k") for k, t in enumerate(texts)], SCHEMA)


def brute(texts):
    low = [(t or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for t in texts]
    groups = defaultdict(list)
    for k, t in enumerate(low):
        groups[t].append(k)
    return {k: (max(groups[t]), len(groups[t]), k == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for k, t in enumerate(low)}


def found(df):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["digest"]) for r in df.collect()}


def test_equals_brute_force(spark):
    assert found(exact_dedup.exact_dedup(docs(spark))) == brute(TEXTS)


def test_small_buckets_double_the_directory(spark):
    assert found(exact_dedup.exact_dedup(docs(spark), capacity=4)) == brute(TEXTS)
    index = exact_dedup.build_index(docs(spark), capacity=4)
    assert index.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 4
    assert index.count() == len(set(brute(TEXTS)[k][0] for k in range(len(TEXTS))))


def test_directory_slots_cover_all_prefixes(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("h")).persist()
    leaves = exact_dedup.directory(df, capacity=50)
    deep, slots = exact_dedup.slots(leaves)
    assert [s for s, _, _ in slots] == list(range(1 << deep)) and all(b <= s for s, b, _ in slots)
    unsigned = [r["h"] % (1 << 64) for r in df.collect()]
    assert all(sum(h >> 64 - d == p for h in unsigned) <= 50 for d, p in leaves if d) and len(leaves) > 20
    assert exact_dedup.directory(spark.range(1).select(F.lit(5).cast("long").alias("h")), capacity=1) == [(0, 0)]


def test_buckets_split_as_deep_as_it_takes(spark):
    """Keys that agree on 50 leading bits."""
    df = spark.range(64).select((F.lit(0x1234567 << 32) + F.col("id") * 64).alias("h"))
    leaves = exact_dedup.directory(df, capacity=2)
    assert max(d for d, _ in leaves) > 50 and sum((p + 1 << 64 - d) - (p << 64 - d) for d, p in leaves) == 1 << 64
    placed = exact_dedup._place(df, leaves, 5)
    assert placed.count() == 64 and placed.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 2


@pytest.mark.parametrize("digest", [None, lambda c: F.length(c).cast("string")])
def test_colliding_keys_are_chained(spark, digest):
    """All keys of one length collide; with a weak digest even that is equal for different texts."""
    key = lambda c: F.length(c).cast("long")
    out = exact_dedup.exact_dedup(docs(spark), key=key, **({"digest": digest} if digest else {}))
    want = {k: v[:3] for k, v in brute(TEXTS).items()}
    assert {k: v[:3] for k, v in found(out).items()} == want


def test_empty_table_and_null_ids(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).isEmpty()
    df = spark.createDataFrame([(None, "a"), (3, "A"), (None, "b")], "doc_id long, text string")
    out = {(r["doc_id"], r["digest"][:4]): (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df).collect()}
    assert sorted(out.values(), key=str) == sorted([(3, 2, False), (3, 2, True), (None, 1, True)], key=str)


def test_deduplicate_keeps_columns_and_one_of_repeated_rows(spark):
    df = docs(spark, ["a", "A", "b"]).unionByName(docs(spark, ["a", "A", "b"]))
    out = exact_dedup.deduplicate(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 2]
    same_id = spark.createDataFrame([(1, "x"), (1, "y"), (2, "X")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.deduplicate(same_id).collect()) == [(1, "y"), (2, "X")]


def test_decisions_are_read_from_the_bucket_of_the_key(spark):
    """What a document reports is what the entry says that lies in the folder of its key's bucket."""
    df = docs(spark)
    own = exact_dedup.index(df, capacity=4)
    keys = {r["doc_id"]: r["h"] % (1 << 64) for r in own.keys.collect()}
    entries = {(r["bucket"], r["h"] % (1 << 64)): (r["keep_id"], r["group_size"]) for r in own.entries.collect()}
    bucket = lambda h: next(k for k, (d, p) in enumerate(own.leaves) if h >> 64 - d == p)
    want = brute(TEXTS)
    assert len(own.leaves) > 8 and all(entries[bucket(h), h] == want[k][:2] for k, h in keys.items())
    plan = own.entries.where("bucket = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_hot_texts_are_folded_before_their_owner(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_COPIES", 3)
    texts = ["hot"] * 500 + ["Hot"] * 300 + [f"t{k % 90}" for k in range(300)] + [None] * 50
    assert found(exact_dedup.exact_dedup(docs(spark, texts))) == brute(texts)
    assert exact_dedup.index(docs(spark, texts)).hot.count() == 32  # "hot", the empty text, and 30 texts of four copies


def test_deduplicate_with_clashing_columns_nulls_and_ties(spark):
    rows = [(1, "a", 5), (1, "A", 6), (None, "n", 1), (None, "n", 2), (2, None, 7), (3, "", 8), (1, "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x int")
    for name in ("gone_id", "gone_digest", "again", "_gone_id", "h", "norm", "kept", "bucket", "owner", "keep_id", "i", "d"):
        df = df.withColumn(name, F.col("x"))
    out = exact_dedup.deduplicate(df)
    got = out.collect()
    assert out.columns == df.columns and sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in got) == [(0, "n"), (1, "a"), (3, "")]
    assert all(r["gone_id"] == r["x"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, exact_dedup.deduplicate(df.repartition(5)).collect()))


def test_stays_in_the_engine(spark):
    plan = exact_dedup.exact_dedup(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))


def test_owners_grow_with_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "OWNER_BYTES", 1_000)
    seen, plain = [], exact_dedup._place
    monkeypatch.setattr(exact_dedup, "_place", lambda rows, leaves, owners: seen.append(owners) or plain(rows, leaves, owners))
    df = spark.createDataFrame([(k, f"{k % 50} " * 40) for k in range(300)], "doc_id long, text string")
    out = exact_dedup.exact_dedup(df).collect()
    assert max(seen) > 20 and {(r["doc_id"], r["keep_id"], r["group_size"]) for r in out} == {(k, 250 + k % 50, 6) for k in range(300)}

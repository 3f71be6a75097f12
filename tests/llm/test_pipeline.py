from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidewright.llm.common import documents, write_table

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = documents(spark, SMALL), []
    for name, stage in cp.STAGES:
        docs = write_table(stage(spark, docs, SMALL), name.replace(" ", "-"))
        out.append((name, docs))
    return dict(out)


def test_stages_in_order(stages, spark):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "sentencepiece"]
    columns = documents(spark, SMALL).columns
    assert all(stages[n].columns == columns for n, _ in cp.STAGES[:-1])


def test_toxic_documents_go_and_clean_ones_stay(stages, spark):
    kept = {r["doc_id"] for r in stages["toxicity"].select("doc_id").collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    toxic = [r["doc_id"] in kept for r in labels if r["toxic"]]
    clean = [r["doc_id"] in kept for r in labels if not r["toxic"]]
    assert sum(toxic) / len(toxic) < 0.3 and sum(clean) / len(clean) > 0.97


def test_one_row_of_each_text_stays(stages):
    fold = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    before, after = ({}, {})
    for r in stages["toxicity"].collect():
        t = (r["text"] or "").translate(fold)
        before[t] = max(before.get(t, -1), r["doc_id"])
    for r in stages["exact dedup"].collect():
        t = (r["text"] or "").translate(fold)
        assert t not in after
        after[t] = r["doc_id"]
    assert after == before


def test_near_copies_go(stages):
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    before = {r["doc_id"]: shingles(r["text"]) for r in stages["exact dedup"].collect()}
    kept = {r["doc_id"] for r in stages["near dedup"].collect()}
    share = Counter()
    for a, x in before.items():
        near = [b for b, y in before.items() if b != a and len(x & y) >= 0.85 * len(x | y)]
        if near:
            share["seen"] += 1
            share["both"] += a in kept and any(b in kept for b in near)
        if a not in kept:
            share["gone"] += 1
            share["unlike"] += not any(len(x & y) >= 0.5 * len(x | y) for b, y in before.items() if b != a)
    assert share["both"] == 0 and share["unlike"] == 0


def test_mix_repeats_rows(stages):
    before = {r["doc_id"]: r for r in stages["near dedup"].collect()}
    times = Counter(r["doc_id"] for r in stages["mixing"].collect())
    assert set(times) <= set(before) and max(times.values()) <= 3


def test_encoding_covers_all_rows(stages):
    out = stages["sentencepiece"]
    assert out.count() == stages["mixing"].count() and out.where("not lossless").isEmpty()


def test_empty_documents(spark):
    docs = documents(spark, SMALL).limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.isEmpty()
        docs = documents(spark, SMALL).limit(0)


def test_odd_rows_pass_all_stages(spark):
    """Null ids, texts and sources, repeated rows, a very long text and further columns with clashing names."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [(1, "some plain words of a text", "a"), (1, "some plain words of a text", "a"), (2, None, "a"), (3, "", None), (None, "a text without id of its own", "b"), (None, None, None), (4, long, "b"), (5, long + " end", "b"), (6, "x" * 400_000, "a"), (7, "Some plain words of a text", "c")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("copies", "rank", "own", "s", "gone_id", "gone_hash", "toxicity_", "size", "words", "h", "norm", "again"):
        docs = docs.withColumn(name, F.col("n_chars"))
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = write_table(stage(spark, docs, SMALL), "odd")
        assert docs.columns == columns
        assert all(r["own"] == r["n_chars"] == len(r["text"] or "") for r in docs.collect())
        ids = Counter((r["doc_id"], r["n_chars"]) for r in docs.collect())
        if name == "exact dedup":
            assert (7, 26) in ids and (1, 26) not in ids and ids[3, 0] == 1 and (2, 0) not in ids and (None, 0) not in ids
        if name == "near dedup":
            assert (4, len(long)) in ids and (5, len(long) + 4) not in ids and (None, 28) in ids
    out = cp.STAGES[-1][1](spark, docs, SMALL)
    assert out.count() == docs.count() and out.where("not lossless").isEmpty()

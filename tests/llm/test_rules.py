"""The rule ledger against plain Python, its policies and its reports."""

import random
import re
from collections import Counter

from tidewright.llm import queries, rules

DATA = "/root/testdata/sf0.001"


def expected(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def check(row, text):
    want = expected(text)
    assert {k: row[k] for k in want} == want
    broken = sum(1 << k for k, r in enumerate(rules.RULES) if eval(r.fails, {}, {m: row[m] for m in rules.MEASURES}))
    assert row["failed"] == broken


def test_made_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab \n\t#é😀.\x1c-1A", k=rng.randrange(120))) for _ in range(500)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    out = rules.ledger(df).collect()
    assert len(out) == len(texts)
    for r in out:
        check(r, texts[r["doc_id"]])


def test_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = queries.op13_quality_rules(spark, DATA).collect()
    assert len(out) == len(docs)
    for r in out:
        want = expected(docs[r["doc_id"]])
        assert {k: r[k] for k in want if k != "n_lines"} == {k: v for k, v in want.items() if k != "n_lines"}
        assert r["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]) and not (r["kept"] and r["base_failed"])


def test_good_documents_stay(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    out = queries.op13_quality_rules(spark, "/root/testdata/sf0.01").where("not base_failed").join(labels, "doc_id")
    assert out.where("not kept").count() == 0 and out.count() > 200


def test_odd_rows(spark):
    rows = [(1, None, 5), (1, "", 6), (None, "w " * 60, 7), (2, " \n\t\n", 8), (3, "same line of words here\n" * 30, 9), (4, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int").selectExpr("*", "'a' as failed", "'b' as _words", "'c' as `a.b`")
    out = rules.ledger(df)
    assert out.columns[:3] == ["doc_id", "_words", "a.b"] and out.columns.count("n_words") == 1
    got = {(r["doc_id"], r["n_words"]): r for r in out.collect()}
    assert got[1, 0]["failed"] == 1 and got[2, 0]["failed"] == 1 and got[None, 60]["n_repeat_words"] == 60
    assert got[3, 150]["n_dup_lines"] == 29 and got[3, 150]["failed"] & 0b100010 == 0b100010
    assert rules.ledger(df.limit(0)).collect() == [] and rules.ablation(rules.ledger(df.limit(0))).collect() == []


def test_policies_and_reports(spark):
    bits = {r.name: 1 << k for k, r in enumerate(rules.RULES)}
    rows = [("a", 0, 10), ("a", bits["few_words"], 20), ("b", bits["few_words"] | bits["symbols"], 30), ("b", bits["bullets"], 40), ("b", bits["symbols"], 50)]
    book = spark.createDataFrame(rows, "source string, failed long, n_words long")
    lenient = rules.Policy("lenient", 3, ("few_words", "symbols", "bullets"), allowed=1)
    out = rules.apply_policies(book, [rules.BASE, rules.CURRENT, lenient]).orderBy("n_words").collect()
    assert [(r["kept_base_v1"], r["kept_web_v2"], r["kept_lenient_v3"]) for r in out] == [(True, True, True), (False, False, True), (False, False, False), (True, True, True), (True, False, True)]
    told = {(r["policy"], r["rule"]): r for r in rules.ablation(book, [rules.BASE, rules.CURRENT, lenient]).collect()}
    few = told["web", "few_words"]
    assert (few["n_docs"], few["n_failed"], few["n_kept"], few["n_kept_without"], few["n_only"], few["words_only"]) == (5, 2, 2, 3, 1, 20)
    assert told["base", "few_words"]["n_only"] == 2 and told["base", "repeated_windows"]["n_only"] == 0 and told["lenient", "symbols"]["n_only"] == 1
    side = {r["source"]: r for r in rules.profile(book, "source").collect()}
    assert side["b"]["any_failed"] == bits["few_words"] | bits["symbols"] | bits["bullets"] and side["b"]["all_failed"] == 0 and side["b"]["n_symbols"] == 2


def test_no_python_in_the_plan(spark):
    plan = rules.measure(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan

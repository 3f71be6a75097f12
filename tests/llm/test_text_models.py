import html as H
import json
import re
import subprocess
import sys
import time
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import html_text, licenses, quality, toxicity
from tidewright.llm.queries import op3_toxicity, op4_quality

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labeller():
    return html_text.trained()


def text_of(labeller, page):
    return html_text.extract_texts(labeller, [page])[0]


def test_blocks_decode_and_trim():
    b = html_text.blocks("<p>a &amp; b&nbsp;\n c<br>d<script>x<p>no</script></p><!-- <p>no --><div class='x'>e<b>f</b></div>")
    assert [x.text for x in b] == ["a & b c d", "ef"] and b[1].path == ("div", ".x")
    assert html_text.blocks("") == [] and html_text.blocks("plain")[0].text == "plain"
    assert [x.text for x in html_text.blocks("<ul><li>a<li>b</ul><p>c<p>d")] == ["a", "b", "c", "d"]
    assert [x.text for x in html_text.blocks('<p title="a>b">c</p><p')] == ["c", "<p"]


@pytest.mark.parametrize("part,tail", [("<script x ", ""), ("<a b", ""), ("<svg a='1' b ", ""), ("<a x", '">'), ('<a "', ">"), ("<!x ", ""), ("< ", "")])
def test_broken_markup_takes_linear_time(part, tail):
    start = time.process_time()
    html_text.blocks(part * (1_000_000 // len(part)) + tail)
    assert time.process_time() - start < 10


def test_broken_tags_are_text():
    texts = lambda page: [b.text for b in html_text.blocks(page)]
    assert texts("a < b <p>c") == ["a < b", "c"]
    assert texts("<p title='x>y'>one</p><p title='z>two") == ["one", "<p title='z>two"]
    assert texts("x<script>no</SCRIPT >y<style>gone") == ["xy"]
    assert texts("x<!-- <p>no --><!doctype a>y<!-- gone") == ["xy"]


def test_labeller_on_pages_it_has_not_seen(labeller):
    hit = total = 0
    for b, y in html_text.made_pages(120, seed=4711):
        p = labeller.chance([labeller.inputs(labeller.describe(b))])[0]
        hit += int(((p >= 0.5) == np.array(y)).sum())
        total += len(y)
    assert hit / total > 0.99


def test_pages_against_their_markup(spark, labeller):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract(pages, labeller).collect()}
    same = 0
    for r in pages.collect():
        a = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        a = " ".join(H.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|article)>|<br>", " ", a))).split())
        same += got[r["page_id"]]["text"] == a and got[r["page_id"]]["n_chars"] == len(a)
    assert same == len(got) == 250


def test_deep_pages(labeller):
    """The outer container counts at any depth: replies far down a thread are comments, deep paragraphs of an article are not."""
    text = lambda k: f"The plain words of part {k} say what there is to say about it."
    for depth in (3, 6, 10):
        replies = "".join(f"<ul><li><div><p>{text(k)}</p></div>" for k in range(depth)) + "</li></ul>" * depth
        article = "<article><h1>Title of the page</h1>" + "<div>" * 5 * depth + "".join(f"<p>{text(100 + k)}</p>" for k in range(6)) + "</div>" * 5 * depth + "</article>"
        for mark in ('class="comments"', 'id="comments"'):
            page = f"<html><head><title>Site</title></head><body>{article}<section {mark}><h2>Comments</h2>{replies}</section><footer><p>Copyright us</p></footer></body></html>"
            assert text_of(labeller, page) == " ".join(["Title of the page", *(text(100 + k) for k in range(6))])
    far = html_text.blocks("<section class=comments>" + "<div>" * 5_000 + "x")[0]
    near = html_text.blocks("<section class=comments><div><div>x")[0]
    assert far.path[:2] == ("section", ".comments") and labeller._path(far.element) == labeller._path(near.element)


def test_labels_do_not_depend_on_company(labeller):
    pages = [p for p, _ in (html_text.made_page(np.random.default_rng(k)) for k in range(70))]
    inputs = [labeller.features(html_text.blocks(p)) for p in pages]
    together, alone = labeller.chance(inputs), [labeller.chance([x])[0] for x in inputs]
    assert all((a == b).all() for a, b in zip(together, alone))
    assert html_text.extract_texts(labeller, pages) == [html_text.extract_texts(labeller, [p])[0] for p in pages]


def test_all_words_of_a_block_are_read(labeller):
    block = lambda middle: html_text.blocks("<p>" + "a b " * 200 + middle + " c d" * 200 + "</p>")
    plain, odd, marked = (labeller.describe(block(x)) for x in ("a b", "zzz qqq", "Copyright b"))
    assert plain[1] != odd[1] and sum(plain[1][0].values()) == 802 and plain[2][0, 6] == 0 < marked[2][0, 6]
    slices = labeller.features(html_text.blocks("<p>x y</p>" * (html_text.SLICE + 5)))
    assert len(slices) == html_text.SLICE + 5 and (slices[html_text.SLICE, 4] - 1 < 0).all()


def test_a_very_long_page_among_small_ones():
    """A page of 200,000 blocks with 63 small ones, in a process of its own: below 500 MB, the small ones unchanged."""
    code = """
import resource
from tidewright.llm import html_text
m = html_text.trained()
small = [f"<html><body><nav>menu</nav><article><p>Text number {k} is here.</p></article></body></html>" for k in range(63)]
big = "<html><body><nav>x</nav><article>" + "<p>Short text here.</p>" * 200_000 + "</article></body></html>"
want, got = html_text.extract_texts(m, small), html_text.extract_texts(m, [big, *small])
print(got[1:] == want, len(got[0]), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, cwd=str(Path(__file__).resolve().parents[2]))
    same, length, mb = done.stdout.split()[-3:]
    assert same == "True" and int(length) == 17 * 200_000 - 1 and int(mb) < 500


def test_html_edge_cases(spark, labeller):
    big = "<html><body><nav><ul><li><a href=x>home</a></li></ul></nav><article><h1>T</h1>" + "<p>word word word.</p>" * 5_000 + "</article></body></html>"
    df = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (3, "u", big, 1), (3, "u", big, 1), (None, "u", "<article><p>Text here.</p></article>", 1)], "page_id long, url string, html string, text int")
    out = html_text.extract(df, labeller).collect()
    by = {r["page_id"]: r for r in out}
    assert len(out) == 5 and by[1]["text"] == "" and by[2]["n_chars"] == 0
    assert by[3]["n_chars"] == len("T") + 5_000 * len(" word word word.") and by[None]["url"] == "u"
    assert html_text.extract(df.limit(0), labeller).isEmpty()


def held(spark, query, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    out = query(spark, SMALL).collect()
    mine = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in out if r["held_out"] and r["doc_id"] in labels]
    s, y, p = (np.array(x) for x in zip(*mine))
    rank = s.argsort().argsort()
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    return out, auc, (y == p).mean()


def test_toxicity_on_held_out_rows(spark):
    out, auc, accuracy = held(spark, op3_toxicity, "toxic")
    assert auc > 0.75 and accuracy > 0.85
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)


def test_quality_on_held_out_rows(spark):
    out, auc, accuracy = held(spark, op4_quality, "quality")
    assert auc > 0.97 and accuracy > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in out)


def test_filters_meet_every_place():
    """Block by block gives what one pass over the whole text gives."""
    m = toxicity.Classifier()
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3 * toxicity.BLOCK // 2, toxicity.DIM)).astype(np.float32)
    spans = [(0, 1), (1, 1), (1, 3), (3, toxicity.BLOCK - 1), (toxicity.BLOCK - 1, toxicity.BLOCK + 2), (toxicity.BLOCK + 2, len(x))]
    pooled, where = m._pool(x, spans)
    for i, (a, b) in enumerate(spans):
        for k, w in enumerate(toxicity.WIDTHS):
            runs = [sum(x[p + j] @ m.filters[k][j] for j in range(w)) for p in range(a, min(b - w + 1, a + 40))]
            if b - a < 40 and runs:
                assert np.allclose(np.maximum(np.max(runs, axis=0) + m.bias[k], 0), pooled.reshape(len(spans), len(toxicity.WIDTHS), -1)[i, k], atol=1e-4)
            if not runs:
                assert (where[i, k] == -1).all()


def text_table(spark):
    return spark.createDataFrame([(1, "calm words here", "en", 0.5), (2, None, None, 0.1), (3, "", "xx", 0.1), (4, "long " * 50_000, "en", 0.1), (1, "calm words here", "en", 0.2), (None, "odd  ퟿", "de", 0.2)], "doc_id long, text string, lang string, toxicity double")


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (3, 1), (9, 1), (None, 1), (2, None)]])
def test_scores_without_enough_labels(spark, labels):
    docs = text_table(spark)
    lab = spark.createDataFrame([(a, b, b) for a, b in labels], "doc_id long, quality int, toxic int")
    t = toxicity.score_toxicity(docs, toxicity.train(docs, lab, F.lit(True))).collect()
    q = quality.score_quality(docs, quality.train(docs, lab, F.lit(True))).collect()
    assert len(t) == len(q) == 6 and len({r["toxicity"] for r in t}) == len({r["quality"] for r in q}) == 1
    assert toxicity.score_toxicity(docs.limit(0), toxicity.Classifier()).isEmpty()


def test_scores_of_odd_texts(spark):
    docs = text_table(spark)
    texts = [f"good text number {k}" if k % 2 else f"bad idiot number {k}" for k in range(120)]
    m = toxicity.Classifier().fit(texts, np.array([1 - k % 2 for k in range(120)]), ["en" if k % 3 else None for k in range(120)])
    out = toxicity.score_toxicity(docs, m).collect()
    assert all(0 <= r["toxicity"] <= 1 and r["toxic"] is not None for r in out)
    assert out[0]["toxicity"] == out[4]["toxicity"]
    bad, calm = m.score(["such an idiot number", "a good text"], toxicity.Words(), np.zeros((0, toxicity.DIM), np.float32))[0]
    assert bad > 0.5 > calm


def test_scores_do_not_depend_on_company(spark):
    """A text scored alone, in batches of two sizes and in two partitionings, and the model from the same rows dealt otherwise."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for module, column in ((toxicity, "toxicity"), (quality, "quality")):
        model = module.train(docs, labels, F.lit(True))
        again = module.train(docs.repartition(7), labels.repartition(3), F.lit(True))
        score = toxicity.score_toxicity if module is toxicity else quality.score_quality
        few = docs.where("doc_id % 10 = 0")
        runs = [{r["doc_id"]: r[column] for r in score(x, m).collect()} for x, m in ((docs, model), (few.coalesce(1), model), (docs.repartition(13), again))]
        assert all(runs[0][k] == v for run in runs[1:] for k, v in run.items())
        texts = [r["text"] for r in few.orderBy("doc_id").collect()]
        if module is toxicity:
            start = lambda: (toxicity.Words(), np.zeros((0, 0), np.float32))
            together, alone = model.score(texts, *start())[0], [model.score([t], *start())[0][0] for t in texts]
            blocks = toxicity.BLOCK
            try:
                toxicity.BLOCK = 97
                assert (model.score(texts, *start())[0] == together).all()
            finally:
                toxicity.BLOCK = blocks
        else:
            x = np.array([quality.features(t) for t in texts])
            together, alone = model.chance(model.rank(x)), [model.chance(model.rank(x[[k]]))[0] for k in range(len(x))]
        assert together.tolist() == alone


def test_toxicity_against_plain_sums():
    """The output by the formula: largest window response of each filter, zero at least, times its weight."""
    rng = np.random.default_rng(1)
    m = toxicity.Classifier()
    m.bias += rng.normal(0, 0.1, m.bias.shape).astype(np.float32)
    texts = ["", "one", "one two", "three little words here", "word " * 300 + "idiot", " ".join(f"w{k % 37}" for k in range(900))]
    words = toxicity.Words()
    docs = [words.rows(t) for t in texts]
    got = m.logits(docs, m.answers(words.parts()))
    vectors = {w: sum(m.table[p] for p in toxicity.parts(w) if p < toxicity.BUCKETS) for t in texts for w in t.lower().split()}
    for text, z in zip(texts, got):
        w, want = text.lower().split(), m.shift
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                runs = [sum(vectors[w[i + j]] @ m.filters[k][j][:, f] for j in range(width)) for i in range(len(w) - width + 1)]
                want += max(0.0, max(runs, default=-9e9) + m.bias[k, f]) * m.out[k * toxicity.FILTERS + f]
        assert abs(z - want) < 1e-4


def test_scoring_does_not_copy_what_is_remembered():
    model, words = toxicity.Classifier(), toxicity.Words()
    scores, answers = model.score([" ".join(f"w{k}" for k in range(60_000))], words, np.zeros((0, 0), np.float32))
    held = answers.nbytes
    want = toxicity.Classifier().score(["w1 new w59999", "", "w7"], toxicity.Words(), np.zeros((0, 0), np.float32))[0]
    tracemalloc.start()
    got, answers = model.score(["w1 new w59999", "", "w7"], words, answers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the resized array may count as new, once
    assert (got == want).all() and len(answers) == 60_001 and peak < held + 3_000_000


def test_training_rows_are_bounded_and_chosen_alike(spark):
    docs = spark.createDataFrame([(k % 50, f"text {k} " * (k % 7), "en") for k in range(200)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k % 50, int(k % 3 == 0)) for k in range(100)] + [(None, 1)], "doc_id long, toxic int")
    one = toxicity.labelled(docs, labels, "toxic", F.lit(True), 20).orderBy("doc_id").collect()
    assert len(one) == 20 and one == toxicity.labelled(docs.repartition(5), labels.repartition(4), "toxic", F.lit(True), 20).orderBy("doc_id").collect()
    texts = {k: min(f"text {j} " * (j % 7) for j in range(k, 200, 50)) for k in range(50)}
    assert all(r["text"] == texts[r["doc_id"]] and r["y"] == max(j % 3 == 0 for j in range(r["doc_id"], 100, 50)) for r in one)
    sizes = spark.createDataFrame([(k, 10) for k in range(50)], "doc_id long, n long")
    assert toxicity.within(sizes, "n", 205).count() == 20 and toxicity.within(sizes, "n", 5).count() == 0


def test_quality_against_brute_force_bradley_terry():
    """The ranker prefers what a plain Bradley-Terry fit over all pairs prefers."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, len(quality.FEATURES)))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.3, 80) > 0).astype(int)
    m = quality.Ranker().fit(x, y)
    z = (m._design(x) - m.mean) / m.scale
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(500):
        w += 0.05 * ((d / (1 + np.exp(np.clip(d @ w, -30, 30)))[:, None]).mean(0) - 1e-3 * w)
    r, plain = m.rank(x), z @ w
    assert ((r[y == 1][:, None] > r[y == 0][None]).mean()) > 0.95
    assert np.corrcoef(r, plain)[0, 1] > 0.9


def test_clashing_columns_of_scores(spark):
    docs = spark.createDataFrame([(1, "some words", 7, 8, 9)], "doc_id long, text string, scores int, scores_ int, rank int")
    out = quality.score_quality(docs, quality.Ranker().fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))).collect()[0]
    assert (out["scores"], out["scores_"], out["rank"], out["quality"]) == (7, 8, 0.0, 0.0)


def test_quality_keeps_by_quantile(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(100)], "doc_id long, rank double")
    assert quality.keep_best(df, 0.25).count() == 76 and quality.keep_best(df, 0).count() == 100
    rng = np.random.default_rng(5)
    for values in ([3.5], [1.0] * 9, [0.0, 1e-320, 5e-324], rng.normal(size=999).tolist(), np.round(rng.normal(size=500), 1).tolist(), [*([0.25] * 700), *rng.random(300)]):
        table = spark.createDataFrame([(float(v),) for v in values], "rank double")
        for share in (0.01, 0.25, 0.5, 0.9, 1.0):
            assert quality.rank_quantile(table, share) == sorted(values)[max(1, int(np.ceil(share * len(values)))) - 1]
    assert quality.rank_quantile(df.limit(0), 0.5) is None
    assert len(quality.features(None)) == len(quality.features("Ab c.\nX!! | 9")) == len(quality.FEATURES)


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def brute_licenses(text):
    t = (text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    hits = [(k, lab) for p, lab in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    return len(w), sorted(hits)


LICENSED = [None, "", "MIT license", "mit-licensé mit   license; Apache License apache license", "cc by cc by nc 4 0, (CC BY-NC 4.0)", "the gnu general public license, version 3. gnu general public licenses", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "mit mit license license", "é license mit license日", "x " * 30_000 + "mit license"]


def test_licenses_against_brute_force(spark):
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(LICENSED)], "doc_id long, text string, n_words int")
    scanned = licenses.scan(df)
    out = {r["doc_id"]: r for r in licenses.digest(scanned).collect()}
    for k, t in enumerate(LICENSED):
        n, hits = brute_licenses(t)
        r = out[k]
        assert (r["n_words"], r["n_base"]) == (n, len(hits))
        assert (r["first_word"], r["last_word"]) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert "apache-2.0" in out[6]["labels"] and "cc-by-nc" in out[4]["labels"] and "gpl-3.0" in out[5]["labels"]
    assert licenses.scan(df.limit(0), licenses.Index()).isEmpty()


def test_notices_bear_small_changes(spark):
    text = "permission is hereby granted, free of charge, to any individual obtaining a copy of this library and associated documentation files"
    index = licenses.Index()
    _, notices = index.scan(licenses.words_of("intro words " + text))
    assert [x for _, x, _ in notices] == ["mit-text"] and notices[0][2] < 1
    assert index.scan(licenses.words_of("permission is granted free of charge to copy"))[1] == []
    assert json.dumps(notices)

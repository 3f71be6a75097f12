import functools
import io
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.llm import mixing, pieces, tokens
from tidewright.llm.queries import vocabulary

BPE, PIECES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
TEXTS = [None, "", " ", "Hello world", "Hello world", "a  b\n\n c\td ", "don't 's ünï 日本 <|endoftext|> ½²", "x" * 5_000, "word, " * 20_000, "   q\n"]


def docs(spark, texts=TEXTS):
    ids = [7, 3, 5, 1, 1, None, 100, 50, 60, 2][: len(texts)]
    return spark.createDataFrame(list(zip(ids, texts, ["s"] * len(texts))), "doc_id long, text string, start string")


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def plain_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("shards", [1, 5])
def test_tokens_round_trip(spark, shards):
    manifest = tokens.write_tokens(docs(spark), BPE, shards=shards)
    got = [r for r in tokens.read_tokens(manifest, with_ids=True).orderBy("start").collect()]
    placed = docs(spark).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    order = sorted(placed.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    start = 0
    for r, d in zip(got, order, strict=True):
        ids = plain_ids(d["text"])
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (d["doc_id"], start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    few = tokens.read_documents(manifest, [100, 3, 999])
    assert few[100].tolist() == plain_ids(TEXTS[6]) and few[3].tolist() == [0] and set(few) == {3, 100}


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "end <|endoftext|>", "<|endoftext|> begin", "in<|endoftext|>side", "two  <|endoftext|>  spaces", "<|endoftext|", "<|endoftext |> is text"])
def test_added_tokens_as_the_library_reads_them(text):
    enc = tokens.Encoder(BPE)
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == library().encode(text, add_special_tokens=False).ids
    assert (50256 in np.frombuffer(enc.encode(text), "<u4")) == ("<|endoftext|>" in text)


def test_a_repeated_id_fills_several_shards(spark):
    rows = [(5, f"text number {k} of many") for k in range(400)] + [(4, "first"), (6, "last")]
    manifest = tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), BPE, shards=4)
    sizes = [r["n_docs"] for r in manifest.collect()]
    assert len(sizes) == 4 and max(sizes) < 200
    out = tokens.read_tokens(manifest, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [4] + [5] * 400 + [6]
    assert sorted(map(tuple, (r["ids"] for r in out))) == sorted(tuple(plain_ids(t)) for _, t in rows)
    assert set(tokens.read_documents(manifest, [6])) == {6}


def test_readers_open_only_what_they_need(spark, monkeypatch):
    manifest = tokens.write_tokens(docs(spark), BPE, shards=5)
    rows = sorted(manifest.collect())
    known = [(r["low"], r["high"]) for r in rows if r["low"] is not None]
    assert known == sorted(known) and known[0][0] == 1 and known[-1][1] == 100
    opened, plain = [], tokens._open
    monkeypatch.setattr(tokens, "_open", lambda uri, mode: opened.append(uri) or plain(uri, mode))
    assert set(tokens.read_documents(manifest, [100])) == {100} and len(opened) == 1
    assert tokens.read_documents(manifest, [55, 4]) == {} and tokens.read_documents(manifest, []) == {}
    monkeypatch.undo()
    monkeypatch.setattr(tokens, "SHARD_BYTES", 10_000)
    many = tokens.write_tokens(docs(spark), BPE)
    assert many.agg(F.sum("n_docs")).first()[0] == len(TEXTS)
    with pytest.raises(ValueError, match="pyarrow can open"):
        tokens._open("nowhere://x/y", "r")


def test_tokens_of_an_empty_table(spark):
    assert tokens.read_tokens(tokens.write_tokens(docs(spark).limit(0), BPE)).isEmpty()


def test_file_is_plain_zstandard_and_checksums_are_verified(monkeypatch):
    import zstandard

    monkeypatch.setattr(tokens, "FRAME_IDS", 4)
    out = io.BytesIO()
    ids = [np.arange(k, dtype="<u4").tobytes() for k in (1, 9, 4, 0)]
    assert tokens.write_shard(out, zip([5, None, 7, 8], ids)) == (4, 14)
    raw = out.getvalue()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == b"".join(ids)
    shard = tokens.Shard(io.BytesIO(raw))
    assert [shard.read(k) for k in range(4)] == ids and len(shard.frames) == 5
    broken = bytearray(raw)
    table = raw.rindex(b"\x5e\x2a\x4d\x18") + 8
    broken[table + 8] ^= 1  # the first frame's checksum
    with pytest.raises(ValueError):
        tokens.Shard(io.BytesIO(bytes(broken))).read(0)
    with pytest.raises(ValueError):
        tokens.Shard(io.BytesIO(raw[:-1]))


def test_encoder_equals_the_library_on_odd_texts(monkeypatch):
    import random

    monkeypatch.setattr(tokens, "REMEMBER", 50)
    e, rng = tokens.Encoder(BPE), random.Random(2)
    letters = list("aab Bb1é. ,'\n\t  !%日  ½²_x") + ["don't", "'s", "\xa0", "\x1c", "\x85"]
    for _ in range(1_500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(e.encode(text), "<u4").tolist() + [0] == plain_ids(text)


def test_cuts_keep_the_ids_of_the_library(monkeypatch):
    """White space of all kinds, contractions, letters of several scripts, marks and digits side by side; many texts at once."""
    import random

    monkeypatch.setattr(tokens, "AT_ONCE", 7)
    e, rng = tokens.Encoder(BPE), random.Random(5)
    letters = list("abst 12.,'\"(_\n\t\r    ") + ["'re", "'ll", "é", "×", "÷", "ß", "ŀ", "ȳ", "Ж", "҂", "ό", "日", "ぁ", "、", "’", "—", "\u0301", "½", "ª", "😀", "\xa0", "\x85", "\x0b", "\x1c", "\x00", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b"]
    for most in (3, 6, 30):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, most))) for _ in range(4_000)]
        got = e.encode_many(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in library().encode_batch(texts, add_special_tokens=False)]


def test_stems_and_marks_are_encoded_once(monkeypatch):
    """Words that differ by the marks, digits and line breaks around them cost the library no more than their stems."""
    e = tokens.Encoder(BPE)
    stems = [f"{a}{b}{c}" for a in "klm" for b in "aeiouéñ" for c in "prst"]
    texts = [" ".join(f"{x}{s}{y}" for s in stems for y in (".", ",", "!?", ".\nIn", "'s", "7")) for x in ("", "(", '"', "a-", "3")]
    given = []
    monkeypatch.setattr(e, "_raw", lambda some, raw=e._raw: given.extend(some) or raw(some))
    assert [np.frombuffer(x, "<u4").tolist() + [0] for x in e.encode_many(texts)] == [plain_ids(t) for t in texts]
    assert len(e.known) < 3 * len(stems) and sum(map(len, given)) < 3 * len(" ".join(stems))
    given.clear()
    e.encode_many(texts[::-1])
    assert len(given) <= 1


def test_what_is_remembered_stays_small(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 100)
    e = tokens.Encoder(BPE)
    for k in range(40):
        text = " ".join(["in", "the", "word", *(f"{a}{b}" for a in "klmn" for b in (f"x{k}", f"y{k}"))]) + " " + "zq" * 3_000
        assert np.frombuffer(e.encode(text), "<u4").tolist() + [0] == plain_ids(text)
        assert len(e.known) == e.many.n == e.begin.n == e.met.n <= 100 and e.ids.n <= 16 * 100
    assert " the" in e.known and " word" in e.known


def test_a_vocabulary_with_a_normalizer_is_left_to_the_library(tmp_path):
    from tokenizers import Tokenizer, normalizers

    other = Tokenizer.from_file(BPE)
    other.normalizer = normalizers.Lowercase()
    other.save(str(tmp_path / "other.json"))
    got = tokens.Encoder(str(tmp_path / "other.json")).encode_many(["Hello World, HELLO", ""])
    assert np.frombuffer(got[0], "<u4").tolist() == library().encode("hello world, hello", add_special_tokens=False).ids and got[1] == b""


# SentencePiece

ODD = ["", " ", "  a  b ", "x\n\ty▁z 日本語 😀\U0010ffff", "a" * 300 + " b", "▁▁ ▁", "Hello world", "international understanding of extraordinary circumstances " * 9]


def test_pieces_are_lossless_and_reproducible(spark):
    df = spark.createDataFrame([(k, t, [1]) for k, t in enumerate(ODD)] + [(50, None, [1]), (6, ODD[6], [1]), (None, "null key", [1])], "doc_id long, text string, ids array<int>")
    a = pieces.encode(df, PIECES)
    one = {r["doc_id"]: (r["ids"], r["n_tokens"], r["lossless"]) for r in a.collect()}
    two = {r["doc_id"]: (r["ids"], r["n_tokens"], r["lossless"]) for r in pieces.encode(df.repartition(3), PIECES).collect()}
    assert one == two and all(x[2] and len(x[0]) == x[1] for x in one.values()) and a.count() == len(ODD) + 3
    assert one[0][0] == [] and one[50][0] == []
    other = {r["doc_id"]: r["ids"] for r in pieces.encode(df, PIECES, seed=1).collect()}
    assert other[7] != one[7][0]
    back = {r["doc_id"]: r["decoded"] for r in pieces.decode(a, PIECES).collect()}
    assert all(back[k] == t for k, t in enumerate(ODD))
    assert pieces.encode(df.limit(0), PIECES).isEmpty()


def test_library_decodes_the_ids():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    m = pieces.Pieces(PIECES)
    for k, t in enumerate(["Hello world, again", "naïve façade", "two\nlines"]):
        assert sp.decode(m.sample([t], np.array([k], np.uint64))[0].tolist()) == t


def test_sampling_follows_the_exact_distribution():
    m, word, n = pieces.Pieces(PIECES), " other", 60_000

    def paths(i):
        if i == len(word):
            yield (), 0.0
        for j in range(i + 1, len(word) + 1):
            if (p := m.ids.get(word[i:j])) is not None:
                for rest, c in paths(j):
                    yield (p, *rest), c - m.cost[p]

    want = {p: np.exp(c) for p, c in paths(0)}
    total = sum(want.values())
    keys = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    got = {}
    for ids in m.sample(["other"] * n, keys):
        got[tuple(ids.tolist())] = got.get(tuple(ids.tolist()), 0) + 1
    assert set(got) <= set(want) and all(abs(got.get(p, 0) / n - w / total) < 0.006 for p, w in want.items())


def test_small_memory_changes_nothing(monkeypatch):
    text = "some words and some more words " * 50
    keys = np.array([9], np.uint64)
    want = pieces.Pieces(PIECES).sample([text], keys)[0]
    monkeypatch.setattr(pieces, "REMEMBER", 20)
    monkeypatch.setattr(pieces, "BLOCK", 7)
    assert (pieces.Pieces(PIECES).sample([text], keys)[0] == want).all()


def test_pieces_of_each_key_stay_as_they_were():
    got = pieces.Pieces(PIECES).sample(ODD + ["a \n", " a", "a ", "é▁ thing&&& 56.41.81.205"], np.arange(12, dtype=np.uint64))
    assert [len(x) for x in got] == [0, 1, 5, 18, 41, 11, 2, 48, 3, 2, 2, 21] and zlib.crc32(np.concatenate(got).astype("<u4").tobytes()) == 1258835205


def test_a_full_memory_keeps_the_words_in_use(monkeypatch):
    texts = [" ".join(["the"] * 3 + [f"{a}{b}{k}" for a in ("new", "other") for b in "pqrst"]) for k in range(60)]
    keys = np.arange(60, dtype=np.uint64)
    m = pieces.Pieces(PIECES)
    want = [m.sample([t], keys[k : k + 1])[0].tolist() for k, t in enumerate(texts)]
    monkeypatch.setattr(pieces, "REMEMBER", 900)
    m, learnt = pieces.Pieces(PIECES), []
    monkeypatch.setattr(m, "_learn", lambda words, learn=m._learn: (learnt.extend(words), learn(words)))
    assert [m.sample([t], keys[k : k + 1])[0].tolist() for k, t in enumerate(texts)] == want
    assert learnt.count(" the") == 1 and len(m.known) < 300 < len(learnt)


def test_new_words_do_not_copy_the_known_ones():
    m, rng, key = pieces.Pieces(PIECES), np.random.default_rng(3), np.array([1], np.uint64)
    m.sample([" ".join("".join(x) for x in rng.choice(list("abcdefghij"), (30_000, 12)).tolist())], key)
    m.sample(["neu"], key)  # the room doubles at most once
    tracemalloc.start()
    for k in range(20):
        m.sample([f"neu{k}"], key)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000


def test_new_words_and_a_full_memory_take_little_beside_it(monkeypatch):
    m, rng, key = pieces.Pieces(PIECES), np.random.default_rng(3), np.array([1], np.uint64)
    text = " ".join("".join(x) for x in rng.choice(list("abcdefghij"), (30_000, 12)).tolist())
    tracemalloc.start()
    want = m.sample([text], key)[0].tolist()
    now, learning = tracemalloc.get_traced_memory()
    monkeypatch.setattr(pieces, "REMEMBER", m.code.n)
    assert m.sample([text], key)[0].tolist() == want
    before = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    m._forget()
    forgetting = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert learning - now < 30_000_000 and forgetting < 10 * m.code.n
    assert m.sample([text], key)[0].tolist() == want


# Mixing


def mixed_docs(spark, n=3000):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(["w"] * int(rng.integers(1, 200))) if k % 50 else None, ["hot", "b", "a", None, "e", "z"][0 if k % 3 == 0 else int(rng.integers(0, 6))], 1) for k in range(n)]
    return spark.createDataFrame([*rows, (n, " ".join(["big"] * 9000), "b", 1), (n + 1, None, "empty", 1)], "doc_id long, text string, source string, copies int")


def plain_targets(sizes):
    """Targets of (source, words): weights 5, 2, 1 in code-point order, nulls last, capped at three times."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = {s for s in sizes if s not in capped}
        rate = (total - sum(3 * sizes[s] for s in capped)) / sum(w[s] for s in free) if free else 0
        new = {s for s in free if w[s] * rate >= 3 * sizes[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in capped else w[s] * rate for s in sizes}
        capped |= new


def test_mix_meets_its_targets(spark):
    df = mixed_docs(spark)
    out = mixing.plan_mix(df).collect()
    sizes, taken = {}, {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    want = plain_targets(sizes)
    for r in out:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(5, 0.01 * t)
    again = mixing.plan_mix(df.repartition(7)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in again) == sorted((r["doc_id"], r["copies"]) for r in out)
    rows = mixing.mix(df)
    assert rows.columns == df.columns and rows.count() == sum(r["copies"] for r in out)


def test_inclusion_is_even_within_a_source(spark):
    """Over many seeds each document of a source is taken about as often as any other."""
    rows = spark.createDataFrame([(k, s, 10) for s in ("a", "b", "c") for k in range(1000 * "abc".index(s), 1000 * "abc".index(s) + 40)], "doc_id long, source string, size long")
    rows = rows.persist()
    times = {}
    seeds = 3
    for seed in range(seeds):
        for r in mixing.counts(rows, seed=seed).collect():
            times[r["source"], r["doc_id"]] = times.get((r["source"], r["doc_id"]), 0) + r["copies"]
    for s in "abc":
        mine = np.array([v for (x, _), v in times.items() if x == s]) / seeds
        total = mine.sum()
        assert abs(total - {"a": 75, "b": 30, "c": 15}[s]) <= 1.01
        assert mine.min() >= np.floor(total / 40) and mine.max() <= np.ceil(total / 40)
        assert len(set(mine)) > 1  # other documents with another seed


def plain_expected(sizes, target):
    """Expected copies of documents of these sizes, by bisection."""
    g = np.array([1 + len(bin(s)[2:]) / 16 for s in sizes])
    low, high = 0.0, 3.0
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if np.minimum(3, c * g) @ np.array(sizes) < target else (low, c)
    return np.minimum(3, low * g)


def plain_sample(ids, sizes, target, seed):
    """Copies of each document of one source (distinct ids), document by document."""
    import hashlib

    e = plain_expected(sizes, target)
    copies, gap = np.floor(e + 1e-12).astype(int), 0.0
    p = e - copies
    gap = target - float(copies @ np.array(sizes))
    rank = []
    for i, chance in zip(ids, p):
        u = (int(hashlib.md5(f"{i}:{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        rank.append(u / (1 - u) / (chance / (1 - chance)) if chance > 1e-9 else None)
    left = sorted((r, k) for k, r in enumerate(rank) if r is not None and sizes[k])
    for _ in range(mixing.PHASES):
        fits, room, rest = True, gap, []
        for r, k in left:
            if fits and sizes[k] <= room:
                if sizes[k] <= gap:
                    gap -= sizes[k]
                    copies[k] += 1
                else:
                    fits = False
            if not fits:
                rest.append((r, k))
        left = rest
    last = min(((abs(gap - sizes[k]), r, k) for r, k in left if abs(gap - sizes[k]) < gap), default=None)
    if last:
        copies[last[2]] += 1
    return copies


def test_mix_against_plain_loops(spark, monkeypatch):
    rng = np.random.default_rng(8)
    docs = [(k, "abc"[k % 3], int(2 ** rng.uniform(0, 9))) for k in range(150)]
    rows = spark.createDataFrame(docs, "doc_id long, source string, size long").persist()
    want = plain_targets({s: sum(n for _, x, n in docs if x == s) for s in "abc"})
    monkeypatch.setattr(mixing, "BINS", 8)  # so that bins are cut again
    monkeypatch.setattr(mixing, "LEAF", 3)
    got = {r["doc_id"]: r["copies"] for r in mixing.counts(rows, seed=5).collect()}
    for s in "abc":
        own = [(i, n) for i, x, n in docs if x == s]
        plain = plain_sample([i for i, _ in own], [n for _, n in own], want[s], 5)
        assert [got[i] for i, _ in own] == plain.tolist()


def test_inclusion_frequencies_follow_the_probabilities():
    """Over many seeds a document is taken about as often as expected, larger ones more often; words come near the target."""
    rng = np.random.default_rng(9)
    sizes = [int(x) for x in 2 ** rng.uniform(4, 11, 400)]
    for share in (0.4, 1.3):
        target = share * sum(sizes)
        e, runs = plain_expected(sizes, target), [plain_sample(range(400), sizes, target, seed) for seed in range(300)]
        often = np.mean(runs, axis=0)
        # documents that close the gap come on top: small ones, a few of a source
        assert abs(often - e).mean() < 0.04 and abs(often.sum() - e.sum()) < 10
        groups = [np.array([len(bin(n)) - 2 == h for n in sizes]) for h in range(5, 12)]
        assert all(abs(often[g].mean() - e[g].mean()) < 0.06 for g in groups)
        assert often[groups[-1]].mean() > often[groups[2]].mean() + 0.02
        assert max(abs(x @ np.array(sizes) - target) for x in runs) < 0.01 * target


def test_mix_keeps_clashing_columns(spark):
    df = mixed_docs(spark, 60)
    for name in ("own", "own_", "times", "salt", "salt_b", "s", "c", "phases", "_mix_copies", "_mix_source", "_mix_copy", "size", "words", "rank"):
        df = df.withColumn(name, F.lit(7))
    out = mixing.mix(df)
    plan = mixing.plan_mix(df)
    assert out.columns == df.columns and out.count() == plan.agg(F.sum("copies")).first()[0]
    assert all(set(r.asDict()[c] for c in df.columns[4:]) == {7} for r in out.collect())


def test_hot_source_and_repeated_ids(spark):
    """A source with most rows, one id that half of its rows repeat, ties of all kinds: reruns agree, nothing exceeds the cap."""
    rows = spark.createDataFrame([(7 if k % 2 else k, "hot", 1 + k % 9) for k in range(4000)] + [(None, None, 3), (None, "x", 0), (1, "x", 5)], "doc_id long, source string, size long")
    one, two = (sorted((r["doc_id"] or -1, r["source"] or "", r["size"], r["copies"]) for r in mixing.counts(x).collect()) for x in (rows.persist(), rows.repartition(11)))
    assert one == two and len(one) == 4003 and all(0 <= c <= 3 for *_, c in one)


def test_mix_edge_cases(spark):
    df = mixed_docs(spark, 30)
    assert mixing.plan_mix(df.limit(0)).isEmpty() and mixing.mix(df.limit(0)).isEmpty()
    none = df.withColumn("text", F.lit(None).cast("string"))
    assert {r["taken"] for r in mixing.plan_mix(none).collect()} == {0}
    same = df.where("doc_id = 1").unionByName(df.where("doc_id = 1"))
    out = mixing.plan_mix(same).collect()
    assert len(out) == 2 and out[0] == out[1]


def test_words_are_counted_in_batches(spark):
    """No string of each word is made, and the mix counts the words of each text once a pass."""
    odd = ["", " ", "a", " a", "a ", "a\tb\nc\x0bd\x0ce\rf", "\u00a0 \u2003x \x1c\x85", "\U0001f600 \U0001f600", None, "\r\n", "word " * 50_000, "a", "\x00 \x08"]
    df = spark.createDataFrame([(k, x, f"s{k % 3}") for k, x in enumerate(odd)], "doc_id long, text string, source string")
    want = {k: len(re.findall(r"[^\x20\x09-\x0D]+", x or "")) for k, x in enumerate(odd)}
    assert {r["doc_id"]: r["size"] for r in mixing.plan_mix(df.coalesce(1)).collect()} == want
    assert mixing.count_words(pa.array(["x", "b c", None, " d"])[1:]).to_pylist() == [2, 0, 1] and mixing.count_words(pa.array([], "string")).to_pylist() == []
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and len(re.findall("ArrowEvalPython", plan)) == 1

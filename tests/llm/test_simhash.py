import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewright.llm import simhash
from tidewright.llm.common import components


def plain_fingerprint(text, width=3):
    w = [x for x in (text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})).encode().split()]
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def near(fps, d=3):
    return [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= d]


@pytest.mark.parametrize("text", [None, "", "  ", "One", "one two", "One\ttwo\x0bthree É ß", "a " * 500, "w x y z " * 40_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_no_break_space_does_not_split():
    assert simhash.fingerprint("a b c d") == plain_fingerprint("a b c d")


def test_gray_rank_inverts_the_code():
    i = np.arange(5000, dtype=np.uint64) * np.uint64(3689348814741910)
    assert (simhash.gray_rank(i ^ (i >> np.uint64(1))) == i).all()


@pytest.mark.parametrize("seed", range(4))
def test_index_joins_what_brute_force_joins(seed):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(400):  # dense clusters and chains
        x = rng.choice(fps)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    groups = [rng.randrange(3) for _ in fps]
    a, b = simhash.gray_index_links(np.array(groups), np.array(fps, np.uint64))
    want = [(x, y) for x, y in near(fps) if groups[x] == groups[y]]
    assert classes(len(fps), zip(a.tolist(), b.tolist())) == classes(len(fps), want)
    assert len(a) < len(fps)


def test_index_of_nothing_and_of_equal_values():
    assert len(simhash.gray_index_links(np.array([], int), np.array([], np.uint64))[0]) == 0
    a, _ = simhash.gray_index_links(np.zeros(50, int), np.zeros(50, np.uint64))
    assert len(a) == 49


@pytest.mark.parametrize("seed", range(3))
def test_two_blocks_are_joined_across_only(seed):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(20)]
    fps += [x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for x in fps for _ in range(9)]
    groups = [rng.randrange(2) for _ in fps]
    a, b = simhash.gray_index_links(np.array(groups), np.array(fps, np.uint64), cross=True)
    want = [(x, y) for x, y in near(fps) if groups[x] != groups[y]]
    assert classes(len(fps), zip(a.tolist(), b.tolist())) == classes(len(fps), want)
    assert len(simhash.gray_index_links(np.ones(5, int), np.zeros(5, np.uint64), cross=True)[0]) == 0


def test_node_pairs_keep_all_near_pairs_and_prune(spark):
    """Blocks that hold a near pair meet; most other pairs of blocks are pruned by the bits their members share."""
    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(3000)]
    fps = list(dict.fromkeys(fps + [x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for x in fps[:1000]]))
    rank = simhash.gray_rank(np.array(fps, np.uint64))
    order = [r["o"] for r in spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "k long, f long").orderBy("k").select(simhash._order(F.col("f")).alias("o")).collect()]
    assert np.array_equal(np.argsort(order), np.argsort(rank))
    place = np.empty(len(fps), int)
    place[np.argsort(rank)] = np.arange(len(fps)) // 8
    df = spark.createDataFrame([(int(b), f - (1 << 64) if f >> 63 else f) for b, f in zip(place, fps)], "block int, fp long")
    met = {(r["a"], r["b"]) for r in simhash.node_pairs(df).collect()}
    x = np.array(fps, np.uint64)
    for k in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[k]) <= 3):
            assert (min(place[k], place[j]), max(place[k], place[j])) in met
    blocks = place.max() + 1
    assert len(met) < 0.5 * blocks * (blocks + 1) / 2


@pytest.mark.parametrize("block", [100_000, 6])
def test_documents_against_brute_force(spark, block):
    """A small block makes a tree of several levels."""
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(3, 60))) for _ in range(15)]
    texts = [None, "", " ", "x", "X"]
    for t in base:
        texts.append(t)
        for _ in range(6):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts, ["q"] * len(ids))), "doc_id long, text string, fp string")
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(df, block=block).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    own = classes(len(texts), near(fps))
    least = defaultdict(lambda: 1 << 60)
    for k, c in enumerate(own):
        least[c] = min(least[c], ids[k])
    for k, t in enumerate(texts):
        assert got[ids[k]] == (fps[k] - (1 << 64) if fps[k] >> 63 else fps[k], least[own[k]])


def test_empty_table_and_repeats(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).isEmpty() and simhash.similar_documents(df).isEmpty()
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "q")], "doc_id long, text string")
    assert simhash.near_duplicates(twice).count() == 3


def test_similarity_classes(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    data, want = [], {}
    for g in range(20):
        w = [word() for _ in range(300)]
        for k in range(3):
            v = list(w)
            for _ in range(2 * k):
                v[rng.randrange(300)] = word()
            data.append((10 * g + k, " ".join(v)))
            want[10 * g + k] = 10 * g
    data += [(1000, "other " + data[0][1][:400]), (1001, None), (1002, "short one")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    assert {k: got[k] for k in want} == want and got[1000] == 1000 and got[1001] == 1001
    kept = sorted(r["doc_id"] for r in simhash.keep_one(df).collect())
    assert kept == sorted({*want.values(), 1000, 1001, 1002})


@pytest.mark.parametrize("edges", [[], [(k, k + 1) for k in range(30)] + [(50, k) for k in range(51, 80)], [(5, 5), (7, 3), (3, 9), (20, 21)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    own = classes(100, edges)
    assert got == {n: own[n] for e in edges for n in e if e[0] != e[1]}


def test_components_of_few_edges_need_few_stages(spark):
    """The driver keeps record of each stage and its tasks, so a round is one job without an exchange."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)], "src long, dst long").coalesce(1)
    spark.sparkContext.setJobGroup("few-edges", "")
    components(edges)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    assert 0 < sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("few-edges")) <= 15


def edited(rng, kind, n=300, similarity=0.8):
    """Two texts whose five-word shingles have barely that Jaccard similarity or more, and the similarity."""
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    w = [word() for _ in range(n)]
    v, s = list(w), n - 4
    if kind == "append":
        v += [word() for _ in range(int(s / similarity - s))]
    elif kind == "insert":
        at = rng.randrange(10, n - 10)
        v[at:at] = [word() for _ in range(int((s - 4) / similarity - s - 4))]
    elif kind == "delete":
        k = int(s * (1 - similarity)) - 9
        at = rng.randrange(10, n - k - 10)
        del v[at : at + k]
    else:
        for k in rng.sample(range(1, n // 6 - 1), int(s * (1 - similarity) / (1 + similarity) / 5)):
            v[6 * k] = word()
    a, b = (simhash.shingle_set(" ".join(x)) for x in (w, v))
    return " ".join(w), " ".join(v), len(a & b) / len(a | b)


@pytest.mark.parametrize("kind", ["append", "insert", "delete", "scatter"])
def test_pairs_at_the_similarity_are_found_whatever_the_edit(spark, kind):
    rng = random.Random(11)
    pairs = [edited(rng, kind) for _ in range(150)]
    assert all(0.8 <= j < 0.83 for _, _, j in pairs)
    df = spark.createDataFrame([(2 * k + s, p[s]) for k, p in enumerate(pairs) for s in (0, 1)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(150)) >= 147


@pytest.mark.parametrize("similarity", [0.6, 0.7, 0.77])
def test_pairs_below_the_similarity_stay(spark, similarity):
    rng = random.Random(12)
    pairs = [edited(rng, kind, similarity=similarity) for kind in ("append", "insert", "delete", "scatter") for _ in range(40)]
    assert all(j < 0.8 for _, _, j in pairs)
    df = spark.createDataFrame([(2 * k + s, p[s]) for k, p in enumerate(pairs) for s in (0, 1)], "doc_id long, text string")
    assert simhash.keep_one(df).count() == df.count()


@pytest.mark.parametrize("small", [64, 4])
def test_classes_are_those_of_exact_pairs(spark, small, monkeypatch):
    """Crowded buckets: candidates that fail must not hide those that hold."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(13)
    texts = [None, "", "A b", "a B"]
    for _ in range(6):
        w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
        for _ in range(25):
            v = list(w)
            for k in rng.sample(range(120), rng.randint(0, 3)):
                v[k] = str(rng.random())
            texts.append(" ".join(v))
    sets = [simhash.shingle_set(t) for t in texts]
    alike = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    assert [got[k] for k in range(len(texts))] == classes(len(texts), alike)


def test_templated_texts_between_half_and_four_fifths(spark):
    """Texts of one template whose sentences have variants: many pairs just below the similarity, some above, no class lost."""
    rng = random.Random(29)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(12))
    variants = [[sentence() for _ in range(2)] for _ in range(12)]
    texts = [". ".join(v[rng.random() < 0.2] for v in variants) + (f" {sentence()}" if rng.random() < 0.5 else "") for _ in range(150)]
    sets = [simhash.shingle_set(t) for t in texts]
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(150) for b in range(a)}
    assert sum(0.5 < x < 0.8 for x in share.values()) > 2000 and sum(x >= 0.8 for x in share.values()) > 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    assert [got[k] for k in range(150)] == classes(150, [p for p, x in share.items() if x >= 0.8])


def test_lone_shingles_rule_out_no_link(spark):
    rng = random.Random(30)
    words = lambda n: " ".join(str(rng.random()) for _ in range(n))
    base = words(80)
    texts = ["", *(f"{base} {words(k)}" for k in range(40) for _ in range(2)), "few words"]
    sets = [simhash.shingle_set(t) for t in texts]
    times = Counter(x for s in sets for x in s)
    rows = spark.createDataFrame(list(enumerate(texts)), "rep long, text string")
    lone = {r["rep"]: r["lone"] for r in simhash.lone_shingles(rows, 5).collect()}
    assert lone == {k: n for k, s in enumerate(sets) if (n := sum(times[x] == 1 for x in s))}
    again = simhash.lone_shingles(rows.union(spark.createDataFrame([(5, "another text of that id here")], rows.schema)), 5)
    assert 5 not in {r["rep"] for r in again.collect()}
    signed = spark.createDataFrame([(k, s.tolist(), lone.get(k, 0)) for k, s in enumerate(simhash.Signer().sign(texts))], "rep long, s array<long>, lone long")
    most = simhash.bits_at(0.8, 64 * simhash.ALL_CHECKS)
    pairs = [{(r["a"], r["b"]) for r in simhash.candidates(d, most, every=True, checks=simhash.ALL_CHECKS, similarity=0.8).collect()} for d in (signed.drop("lone"), signed)]
    links = {(a, b) for a, b in pairs[0] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert links <= pairs[1] < pairs[0] and len(links) > 100


def test_bucket_pairs_connect_and_cover():
    rng = np.random.default_rng(14)
    key = np.sort(rng.integers(0, 4, 300))
    check = rng.integers(0, 1 << 12, (300, 1)).astype(np.uint64)
    part = rng.integers(0, 3, 300)
    near = [(a, b) for a in range(300) for b in range(a + 1, 300) if key[a] == key[b] and int(check[a, 0] ^ check[b, 0]).bit_count() <= 2]
    pairs = lambda chunks: [p for x, y in chunks for p in zip(x.tolist(), y.tolist())]
    assert classes(300, pairs(simhash.bucket_pairs(key, check, 2))) == classes(300, near)
    own = {p: [k for k in range(300) if (key[k], part[k]) == p] for p in zip(key, part)}
    same = [(v[0], x) for v in own.values() for x in v[1:]]
    apart = pairs(simhash.bucket_pairs(key, check, 2, part))
    assert classes(300, apart + same) == classes(300, near + same) and all(part[a] != part[b] for a, b in apart) and len(apart) <= len(pairs(simhash.bucket_pairs(key, check, 2)))
    for held in (1 << 20, 10):
        assert sorted(pairs(simhash.bucket_pairs(key, check, 2, part, held, every=True))) == [(a, b) for a, b in near if part[a] != part[b]]
    chunks = list(simhash.bucket_pairs(np.zeros(3000, int), np.zeros((3000, 2), np.uint64), 2, None, 50_000, every=True))
    assert sum(len(x) for x, _ in chunks) == 3000 * 2999 // 2 and max(len(x) for x, _ in chunks) < 60_000


def test_candidates_come_from_the_tree(spark):
    """Pairs within the distance of one code, as by brute force, also where no 16 bits of the fingerprints agree."""
    rng = np.random.default_rng(31)
    prints = rng.integers(0, 1 << 32, (60, simhash.PRINTS), dtype=np.uint32)
    prints[1] = prints[0] ^ np.uint32(0x10001)  # one bit of each 16
    for k in range(2, 60):  # some bits of one code, and more of all others
        prints[k] = prints[k // 2] ^ (np.uint32(1) << rng.integers(0, 32, simhash.PRINTS).astype(np.uint32) | np.uint32(0x300))
        prints[k, k % 36] = prints[k // 2, k % 36] ^ np.uint32((0, 1, 3, 7, 1 << 31)[k % 5])
    s = np.concatenate([np.zeros((60, 2), np.int64), prints.view(np.int64), np.full((60, 1), 50)], axis=1)
    signed = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(s)], "rep long, s array<long>").persist()
    code = simhash.codes(prints)
    apart = np.bitwise_count(code[:, :, None, None] ^ code[:1, None, None, :])  # the first row's tables among themselves
    assert all(apart[0, t, 0, u] > simhash.APART for t in range(simhash.TABLES) for u in range(t))
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if (np.bitwise_count(code[a] ^ code[b]) <= simhash.APART).any() and np.bitwise_count(prints[a] ^ prints[b]).sum() <= 200}
    assert (0, 1) in want and not (prints[0].view(np.uint16) == prints[1].view(np.uint16)).any() and 20 < len(want) < 1770
    for hot in (1 << 17, 100):
        got = simhash.candidates(signed, 200, hot, every=True, checks=simhash.ALL_CHECKS)
        assert {(r["a"], r["b"]) for r in got.collect()} == want


def test_hot_buckets_are_cut_and_lose_no_pair(spark):
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    base = words(80)
    texts = [f"{base} {words(3)}" for _ in range(60)] + [words(70) for _ in range(40)]
    signed = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(simhash.Signer().sign(texts))], "rep long, s array<long>").persist()
    parted = signed.withColumn("part", F.col("rep"))
    most = simhash.bits_at(0.8)
    whole, cut = ({(r["a"], r["b"]) for r in simhash.candidates(parted, most, hot, every=True).collect()} for hot in (50_000, 7))
    assert whole == cut and len(whole) >= 60 * 59 // 2
    joined = [classes(100, [(r["a"], r["b"]) for r in simhash.candidates(signed, most, hot).collect()]) for hot in (50_000, 7)]
    assert joined[0] == joined[1]


def test_keep_one_with_clashing_columns_nulls_and_repeats(spark):
    t = " ".join(f"w{k}" for k in range(40))
    rows = [(1, t, 1), (2, t + " x", 2), (3, None, 3), (4, "", 4), (None, t, 5), (None, None, 6), (5, "other text of few words", 7), (5, "other text of few words", 7), (2, t + " x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x int")
    for name in ("gone_id", "gone_hash", "_gone_id", "_gone_hash", "rep", "s", "part", "key", "text_hash", "component_id"):
        df = df.withColumn(name, F.col("x"))
    out = simhash.keep_one(df)
    assert out.columns == df.columns and sorted(r["x"] for r in out.collect()) == [1, 3, 5, 6, 7, 7]
    assert all(r["gone_id"] == r["component_id"] == r["x"] for r in out.collect())


def test_very_long_texts(spark):
    long = " ".join(f"word{k % 9973}" for k in range(300_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x" * 3_000_000)], "doc_id long, text string")
    assert [r["component_id"] for r in simhash.near_duplicates(df).orderBy("doc_id").collect()][:2] == [1, 1]
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == [1, 3]

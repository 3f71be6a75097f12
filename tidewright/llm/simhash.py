"""SimHash near-duplicate detection over a Gray-order hierarchical index.

The distinct fingerprints are sorted by their rank in the reflected Gray code and cut into blocks of that order.  A block
is the lowest node of a tree over the whole table; it keeps the bits that its members share (neighbours in Gray order
share nearly all leading bits, even across a power of two), and upper nodes keep what their children share.  Pairs of
nodes are followed from the root down: where the bits fixed in both nodes differ in more than `distance` places, the two
groups are pruned with all that lies below them.  Only pairs of blocks that stay are compared, each in a task of its own,
by the same tree carried on down to the single fingerprint; there a pair of nodes is also done once a link chain joins
all members of both.  The tables of nodes and of their pairs stay tables; a task holds two blocks at most.

The tree decides which fingerprints meet: with G blocks a block meets about those whose leading log2(G) bits differ in
`distance` places or fewer, which is what a block is sent to.  Larger blocks send less and hold more.

Defined results: null and empty texts have fingerprint zero and link like any other; a null id is kept and forms a
component of its own id (null) with equal fingerprints; repeated rows are repeated in the result; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, release_memory, small_batches, unused, write_table

BITS = 64
#: Distinct fingerprints in one block of the order, and children of a node above the blocks (a power of two, in bits).
BLOCK, UPPER_BITS = 1 << 17, 3
FANOUT = 2
#: Partitions that the pairs of blocks are dealt to at most; a task takes its pairs one after the other.
TASKS = 1 << 14
#: Node pairs that are compared at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned fingerprint of one text: a bit is set when it is set in more than half of the shingles' XXH64 (seed 42)."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        words = [b" ".join(words)]
        width = 1
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):  # a bounded block of the shingles at a time
        part = [words[at + k : min(at + 65_536, n) + k] for k in range(width)]
        h = np.array([digest(b" ".join(x), 42) for x in zip(*part)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, width) for x in texts], np.uint64).view(np.int64))

    return small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), fp(F.coalesce(F.col(text_col), F.lit(""))).alias("fp"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code word in the reflected Gray code (the inverse of i ^ i >> 1)."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of a and b in place; label keeps the smallest member's place."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def gray_tree_pairs(group: np.ndarray, fp: np.ndarray, label: np.ndarray, distance: int = 3, cross: bool = False, equal: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places in the input) of a group and of different labels that are within `distance`, some thousands at a time.

    The input is in order of group and, within it, of the Gray code.  Labels may be joined in place between two steps: nodes whose
    members all have one label are left out from then on.  With `cross` there are two groups, and only pairs of one of each count.
    Without `equal`, pairs of equal fingerprints are left out, and so are nodes that hold nothing else.
    """
    if len(fp) < 2:
        return
    n = len(fp)
    levels = [(fp, fp, np.arange(n), np.arange(n) + 1)]  # bits in all members, bits in any, first child, end of children
    owner = group
    while True:
        every, some, _, _ = levels[-1]
        new = np.r_[True, owner[1:] != owner[:-1]]
        start = np.flatnonzero(new)
        if len(start) == len(owner):
            break
        place = np.arange(len(owner)) - np.repeat(start, np.diff(np.r_[start, len(owner)]))
        first = np.flatnonzero(place % FANOUT == 0)
        levels.append((np.bitwise_and.reduceat(every, first), np.bitwise_or.reduceat(some, first), first, np.r_[first[1:], len(owner)]))
        owner = owner[first]
    # the leaves below each node, as a range
    spans = [(np.arange(n), np.arange(n) + 1)]
    for _, _, first, end in levels[1:]:
        lo, hi = spans[-1]
        spans.append((lo[first], hi[end - 1]))
    shared = [(every, every ^ some) for every, some, _, _ in levels]
    ragged = [bool((end - first != FANOUT).any()) for _, _, first, end in levels]
    one, other = np.repeat(np.arange(FANOUT), FANOUT), np.tile(np.arange(FANOUT), FANOUT)
    top = len(levels) - 1
    roots = np.flatnonzero(spans[top][1] - spans[top][0] > 1)
    if cross:
        stack = [(top, np.array([0]), np.array([1]))] if len(levels[top][0]) == 2 else []
    else:
        stack = [(top, roots[i : i + CHUNK], roots[i : i + CHUNK]) for i in range(0, len(roots), CHUNK)]
    while stack:
        level, a, b = stack.pop()
        lo, hi = spans[level]
        if level:  # nodes whose members are all joined already need no look
            same = np.r_[0, np.cumsum(label[1:] != label[:-1])]
            done = (same[lo[a]] == same[hi[a] - 1]) & (same[lo[b]] == same[hi[b] - 1]) & (label[lo[a]] == label[lo[b]])
            a, b = a[~done], b[~done]
        _, _, first, end = levels[level]
        if not level:
            near = (a != b) & (label[a] != label[b])
            a, b = a[near], b[near]
            near = np.bitwise_count(fp[a] ^ fp[b]) <= distance
            if near.any():
                yield a[near], b[near]
            continue
        x = (first[a][:, None] + one).ravel()
        y = (first[b][:, None] + other).ravel()
        keep = x <= y  # a node with itself: each pair of its children once
        if ragged[level]:
            keep &= (x < np.repeat(end[a], len(one))) & (y < np.repeat(end[b], len(one)))
        if level == 1:
            keep &= x != y
        x, y = x[keep], y[keep]
        # bits that all members of a node share are those where the bits in all and in any agree
        bits, loose = shared[level - 1]
        apart = bits[x] ^ bits[y]
        apart &= ~(loose[x] | loose[y])
        keep = np.bitwise_count(apart) <= distance
        if not equal:
            keep &= (bits[x] != bits[y]) | ((loose[x] | loose[y]) != 0)
        x, y = x[keep], y[keep]
        far = np.argsort(x != y, kind="stable")[::-1]  # a node with itself comes off the stack first
        x, y = x[far], y[far]
        stack += [(level - 1, x[i : i + CHUNK], y[i : i + CHUNK]) for i in range(0, len(x), CHUNK)]


def gray_index_links(group: np.ndarray, fp: np.ndarray, distance: int = 3, cross: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links (places in the input) that connect, within each group, whatever pairs within `distance` connect.

    With `cross` there are two groups, and only pairs of one of each count.  Only links that join two classes come back,
    so there are fewer of them than fingerprints.
    """
    order = np.lexsort((gray_rank(fp), group))
    label = np.arange(len(fp))
    for a, b in gray_tree_pairs(group[order], fp[order], label, distance, cross):
        _merge(label, a, b)
    joined = np.flatnonzero(label != np.arange(len(fp)))  # each member of a class with its first
    return order[joined], order[label[joined]]


def _order(fp: Column) -> Column:
    """gray_rank of a signed long, as a signed long of the same order."""
    rank = fp
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def node_pairs(blocks: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks (block, fp, ...) that the tree's upper nodes do not prune; a stored table."""
    nodes = write_table(blocks.groupBy(F.col("block").alias("node")).agg(F.bit_and("fp").alias("every"), F.bit_or("fp").alias("some")), "nodes")
    levels = [nodes]
    height = (nodes.agg(F.max("node")).first()[0] or 0).bit_length()
    for _ in range(0, height, UPPER_BITS):
        above = levels[-1].groupBy(F.shiftright("node", UPPER_BITS).alias("node"))
        levels.append(write_table(above.agg(F.bit_and("every").alias("every"), F.bit_or("some").alias("some")), "nodes"))
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for below in reversed(levels[:-1]):
        side = lambda x: below.select(F.shiftright("node", UPPER_BITS).alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("node", "every", "some")])  # noqa: B023, E731
        met = pairs.join(side("a"), "a").join(side("b"), "b").where("node_a <= node_b")
        loose = F.col("every_a").bitwiseXOR(F.col("some_a")).bitwiseOR(F.col("every_b").bitwiseXOR(F.col("some_b")))
        apart = F.bit_count(F.col("every_a").bitwiseXOR(F.col("every_b")).bitwiseAND(F.bitwise_not(loose)))
        pairs = write_table(met.where(apart <= distance).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "node-pairs")
    return write_table(pairs, "node-pairs")


def links(distinct: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """(src, dst) links between ids of distinct fingerprints (rep, fp; stored), enough to connect all that are within `distance`."""
    parts = max(1, -(-distinct.count() // block))
    ranged, block_of = distinct.select("rep", "fp", _order(F.col("fp")).alias("rank")), F.lit(0)
    if parts > 1:  # a single range is no exchange by range: its tasks may be any
        ranged, block_of = ranged.repartitionByRange(parts, "rank"), F.spark_partition_id()
    blocks = write_table(ranged.select("rep", "fp", block_of.alias("block")), "blocks")
    pairs = node_pairs(blocks, distance)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches arrive sorted by pair of blocks; a pair's rows are held until it ends."""
        held: list[pa.RecordBatch] = []
        now = None

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            rep, fp, own = t["rep"].to_numpy(), t["fp"].to_numpy().view(np.uint64), t["block"].to_numpy()
            x, y = gray_index_links(own, fp, distance, cross=now[0] != now[1])
            yield pa.RecordBatch.from_arrays([pa.array(rep[x]), pa.array(rep[y])], ["src", "dst"])
            release_memory()

        for batch in batches:
            a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else []
            for at, to in zip(cuts, [*cuts[1:], len(a)]):
                pair = (int(a[at]), int(b[at]))
                if pair != now and held:
                    yield from out()
                    held = []
                now = pair
                held.append(batch.slice(at, to - at))
        if held:
            yield from out()

    left = blocks.join(pairs, blocks["block"] == pairs["a"]).select("a", "b", "block", "rep", "fp")
    right = blocks.join(pairs.where("a <> b"), blocks["block"] == F.col("b")).select("a", "b", "block", "rep", "fp")
    tasks = max(1, min(TASKS, pairs.count()))
    return left.unionByName(right).repartition(tasks, "a", "b").sortWithinPartitions("a", "b").mapInArrow(join, "src long, dst long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id reachable over links of `distance` bits or fewer)."""
    fps = write_table(fingerprints(df, id_col, text_col, width), "fingerprints")
    distinct = write_table(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "distinct")
    parts = components(links(distinct, distance, block))
    classes = distinct.join(parts, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


#: Fingerprints of a document's shingles, of PRINT bits each.
PRINTS, PRINT = 36, 32
#: Fingerprints that are indexed, their leading bits that are, and the most bits in which a pair may differ there: a pair of Jaccard
#: similarity 0.8 is met by one of them in 99.8 of 100 cases.
TABLES, CODE, APART = 32, 28, 2
#: 64-bit parts of the fingerprints that a pair of near codes is compared by before its texts are: at first, and where all pairs of
#: different classes are.
CHECKS, ALL_CHECKS = 2, PRINTS * PRINT // 64
#: Standard deviations from the expected distance at the similarity within which the nearest classes are compared, round by round.
NEARER = (-1.0, 0.0)
#: Groups of equal codes up to this size are compared place by place, all of them together.
SMALL = 64
#: Codes in one block of the order; a task holds two blocks.
HOT = 1 << 17
#: Pairs that a task holds before it gives them out.
PAIRS = 1 << 20
#: Shape of the sketch that a document's shingles are counted in.
SKETCH = (32, 64)


def shingle_set(text: str | None, width: int = 5) -> set[bytes]:
    """The distinct runs of `width` words; a shorter text is one run."""
    words = (text or "").encode().lower().split()
    width = max(1, min(width, len(words)))
    return {b" ".join(x) for x in zip(*(words[k:] for k in range(width)))}


def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


class Signer:
    """Signatures of texts: a 128-bit hash of the set of shingles, then PRINTS fingerprints of it, then the number of shingles.

    Each bit is the side of a random plane on which the set lies.  The planes come from two rounds of random signs and a
    Hadamard transform of the signed counts of the shingles' hashes, so a bit costs the same for any length; all sums are
    of whole numbers and exact.
    """

    def __init__(self, width: int = 5):
        rng, size = np.random.default_rng(20_011), SKETCH[0] * SKETCH[1]
        self.width, self.left, self.right = width, _hadamard(SKETCH[0]), _hadamard(SKETCH[1])
        self.signs = [rng.choice([-1.0, 1.0], SKETCH) for _ in range(2)]
        self.taken = rng.permutation(size)[: PRINTS * PRINT]

    def sign(self, texts: list[str | None]) -> np.ndarray:
        out = [self._block(texts[at : at + 256]) for at in range(0, len(texts), 256)]
        return np.concatenate(out) if out else np.zeros((0, 3 + PRINTS * PRINT // 64), np.int64)

    def _block(self, texts: list[str | None]) -> np.ndarray:
        import xxhash

        size = SKETCH[0] * SKETCH[1]
        digest = xxhash.xxh3_64_intdigest
        v, own, n = np.zeros((len(texts), size)), np.zeros((len(texts), 2), np.int64), np.zeros((len(texts), 1), np.int64)
        for k, text in enumerate(texts):
            h = np.array([digest(x) for x in shingle_set(text, self.width)], np.uint64)
            n[k] = len(h)
            if len(h):
                h.sort()
                own[k] = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
                v[k] = np.bincount((h % np.uint64(size)).astype(np.int64), 1.0 - 2.0 * (h >> np.uint64(63)), size)
        v = v.reshape(-1, *SKETCH)
        for signs in self.signs:
            v = self.left @ (v * signs) @ self.right
        bits = v.reshape(-1, size)[:, self.taken] > 0
        return np.concatenate([own, np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.int64), n], axis=1)


def bits_at(similarity: float, bits: int = BITS * CHECKS, deviations: float = 4.5) -> int:
    """Most bits in which fingerprints of that length differ for documents of that Jaccard similarity: the expected number and
    so many standard deviations; with four and a half, no such pair is refused before its texts are compared."""
    cosine = 2 * similarity / (1 + similarity)
    p = np.arccos(cosine) / np.pi
    return int(np.ceil(bits * p + deviations * np.sqrt(bits * p * (1 - p))))


def bucket_pairs(key: np.ndarray, check: np.ndarray, most: int, part: np.ndarray | None = None, held: int = PAIRS, every: bool = False, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places in the input) of one key, which is sorted, whose `check` rows differ in at most `most` bits.

    Without `every`, what such pairs connect is joined by pairs with its first place, one for each part but that place's own
    (each place is a part of its own without `part`).  With it, all pairs of different parts that are `allowed`, given out whenever `held` of
    them have gathered, so memory does not grow with their number.
    """
    if every and part is None:
        part = np.arange(len(key))
    n = len(key)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.array([], int)
    size = np.diff(np.r_[start, n])
    label, found, waiting = np.arange(n), [], 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate(side) for side in zip(*found)) if found else (np.array([], int), np.array([], int))

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(check[a] ^ check[b]).sum(-1, dtype=np.int64) <= most

    last = np.repeat(np.where(size <= SMALL, start + size, 0), size)  # end of each place's bucket, if that is small
    a = np.arange(n)
    for step in range(1, SMALL):
        a = a[a + step < last[a]]
        if not len(a):
            break
        x = a[part[a] != part[a + step]] if every else a
        x = x[near(x, x + step)]
        if not every:
            label = _merge(label, x, x + step)
        else:
            x = x if allowed is None else x[allowed(x, x + step)]
            found.append((x, x + step))
            waiting += len(x)
            if waiting >= held:
                yield joined()
                found, waiting = [], 0
    for at, m in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
        rest = np.arange(at, at + m)
        if not every:  # reach from place to place; what is reached is not compared again
            while len(rest):
                queue, rest = [rest[0]], rest[1:]
                while queue and len(rest):
                    x = queue.pop()
                    ok = near(x, rest)
                    label[rest[ok]] = label[x]
                    queue += rest[ok].tolist()
                    rest = rest[~ok]
        else:
            for x in range(at, at + m - 1):
                y = np.arange(x + 1, at + m)
                y = y[part[y] != part[x]]
                y = y[near(x, y)]
                y = y if allowed is None else y[allowed(np.full(len(y), x), y)]
                found.append((np.full(len(y), x), y))
                waiting += len(y)
                if waiting >= held:
                    yield joined()
                    found, waiting = [], 0
    if not every:
        at = np.flatnonzero(label != np.arange(n))
        if part is not None:
            at = at[part[label[at]] != part[at]]
            at = at[np.unique(np.stack([label[at], part[at]]), axis=1, return_index=True)[1]] if len(at) else at
        found.append((label[at], at))
    yield joined()


def codes(prints: np.ndarray) -> np.ndarray:
    """The codes of each row of fingerprints (PRINT bits each): CODE bits and, above them, the number of the table, written so often
    that codes of different tables are further than APART from each other.  So one tree holds all tables."""
    tag, bits = np.arange(TABLES, dtype=np.uint64), np.uint64((TABLES - 1).bit_length())
    above = sum(tag << (np.uint64(CODE) + np.uint64(k) * bits) for k in range(APART + 1))
    return (prints[:, :TABLES] & np.uint32((1 << CODE) - 1)) | above


def _coded(signed: DataFrame, bounds: list[int], checks: int = 0, more: tuple[str, ...] = ()) -> DataFrame:
    """block, rank, rep (and n, c0, c1, ...): a row for each code of each document.  A block ends at each of the bounds; a code that
    is the bound of several is dealt to all of these by its documents."""
    names = ["block", "rank", "rep", *(["n"] if "n" in more else []), *(f"c{k}" for k in range(checks)), *(c for c in more if c != "n")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.array(bounds, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                s = np.array(batch["s"].flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)[:, 2:]
                s, n = np.ascontiguousarray(s[:, :-1]), s[:, -1]
                rep = batch["rep"].to_numpy(zero_copy_only=False)
                rank = gray_rank(codes(s.view(np.uint32))).view(np.int64).ravel()
                low, high = np.searchsorted(ends, rank, "left"), np.searchsorted(ends, rank, "right")
                block = low + np.repeat(rep * 0x9E3779B1 >> 8, TABLES) % (high - low + 1)
                given = {"n": n} | {f"c{k}": s[:, k] for k in range(checks)} | {c: batch[c].to_numpy(zero_copy_only=False) for c in more if c != "n"}
                cols = [block.astype(np.int32), rank, *(np.repeat(x, TABLES) for x in [rep, *(given[c] for c in names[3:])])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names)

    return signed.select("rep", "s", *(c for c in more if c != "n")).mapInArrow(deal, "block int, rank long" + "".join(f", {c} long" for c in names[2:]))


def code_index(signed: DataFrame, hot: int = HOT) -> tuple[list[int], DataFrame]:
    """The blocks of the codes of signed (rep, s) in Gray order, as their bounds, and the pairs of blocks that the tree's upper nodes do
    not prune.  The driver gets one number a block.  It serves any part of these documents as well."""
    blocks, bounds = max(1, -(-signed.count() * TABLES // hot)), []
    if blocks > 1:
        bounds = _coded(signed, []).agg(F.percentile_approx("rank", [k / blocks for k in range(1, blocks)], max(10_000, 10 * blocks))).first()[0]
    code = F.col("rank").bitwiseXOR(F.shiftright("rank", 1))
    return bounds, node_pairs(_coded(signed, bounds).select("block", code.alias("fp")), APART)


def candidates(signed: DataFrame, most: int, hot: int = HOT, every: bool = False, checks: int = CHECKS, similarity: float = 0.0, index: tuple[list[int], DataFrame] | None = None) -> DataFrame:
    """Distinct (a, b), a < b, from signed (rep, s, and perhaps part, lone): pairs with a code within APART bits and `checks` parts of
    the fingerprints within `most`, found by the Gray-order tree over the codes of all tables.

    Without `every`, what such pairs connect within a pair of blocks is joined by pairs with its smallest rep.  With it, all pairs of
    different parts.  With `every` and all checks, a pair is given out by the first of the tables it meets in only, and with `lone`,
    the number of a document's shingles that no other has, only if the others would do for the similarity.

    A block has about `hot` codes, and a code with more documents several blocks, so a task holds two blocks at most and no pair is
    lost.
    """
    bounds, pairs = index or code_index(signed, hot)
    more = tuple(c for c in ("part", "lone") if c in signed.columns)
    parted, bounded = "part" in more, "lone" in more

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches arrive sorted by pair of blocks; a pair's rows are held until it ends."""
        held: list[pa.RecordBatch] = []
        now = None

        def given(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            pairs = pairs[pairs[:, 0] < pairs[:, 1]]
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            rep, block, rank = t["rep"].to_numpy(), t["block"].to_numpy(), t["rank"].to_numpy().view(np.uint64)
            code, cross = rank ^ rank >> np.uint64(1), now[0] != now[1]
            check = np.stack([t[f"c{k}"].to_numpy().view(np.uint64) for k in range(checks)], axis=1)
            part = np.unique(t["part"].to_numpy(), return_inverse=True)[1] if parted else np.arange(len(rep))
            order = np.argsort(rank, kind="stable")  # equal codes of both blocks together

            def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                return np.bitwise_count(check[x] ^ check[y]).sum(-1, dtype=np.int64) <= most

            if not every:
                label = np.arange(len(rep))
                for x, y in bucket_pairs(rank[order], check[order], most):
                    _merge(label, order[x], order[y])
                for x, y in gray_tree_pairs(block, code, label, APART, cross, equal=False):
                    ok = near(x, y)
                    _merge(label, x[ok], y[ok])
                smallest = np.full(len(rep), np.iinfo(np.int64).max)
                np.minimum.at(smallest, label, rep)
                yield from given(smallest[label], rep)
                return
            prints, table = check.view(np.uint32)[:, :TABLES] & np.uint32((1 << CODE) - 1), (code >> np.uint64(CODE)).astype(np.int64) % TABLES
            n = t["n"].to_numpy()
            rest = n - t["lone"].to_numpy() if bounded else n

            def allowed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                both = np.minimum(rest[x], rest[y])
                ok = both >= similarity * (n[x] + n[y] - both)
                if cross:
                    ok &= block[x] != block[y]
                if checks == ALL_CHECKS:
                    ok[ok] = (np.bitwise_count(prints[x[ok]] ^ prints[y[ok]]) <= APART).argmax(axis=1) == table[x[ok]]
                return ok

            for x, y in bucket_pairs(rank[order], check[order], most, part[order], every=True, allowed=lambda x, y: allowed(order[x], order[y])):
                yield from given(rep[order[x]], rep[order[y]])
            found, waiting = [], 0
            for x, y in gray_tree_pairs(block, code, part, APART, cross, equal=False):
                ok = near(x, y)
                x, y = x[ok], y[ok]
                ok = allowed(x, y)
                found.append((rep[x[ok]], rep[y[ok]]))
                waiting += int(ok.sum())
                if waiting >= PAIRS:
                    yield from given(*(np.concatenate(side) for side in zip(*found)))
                    found, waiting = [], 0
            if waiting:
                yield from given(*(np.concatenate(side) for side in zip(*found)))

        for batch in batches:
            a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else []
            for at, to in zip(cuts, [*cuts[1:], len(a)]):
                pair = (int(a[at]), int(b[at]))
                if pair != now and held:
                    yield from out()
                    held = []
                now = pair
                held.append(batch.slice(at, to - at))
        if held:
            yield from out()
            release_memory()

    coded = _coded(signed, bounds, checks, ("n", *more) if every else more)
    sides = pairs.select(F.col("a").alias("block"), "a", "b").unionByName(pairs.where("a <> b").select(F.col("b").alias("block"), "a", "b"))
    tasks = coded.join(sides, "block").repartition("a", "b").sortWithinPartitions("a", "b", "block", "rank", "rep")
    return tasks.mapInArrow(join, "a long, b long").distinct()


def lone_shingles(texts: DataFrame, width: int) -> DataFrame:
    """(rep, lone): how many shingles of each text (rep, text) no other one has; no row for zero, nor for an id with several texts.
    Counted by 64-bit hashes: where two shingles share one, neither is lone, so the number is never too large."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            own = [np.array([xxhash.xxh3_64_intdigest(x) for x in shingle_set(t, width)], np.uint64) for t in batch["text"].to_pylist()]
            rep = np.repeat(batch["rep"].to_numpy(zero_copy_only=False), [len(h) for h in own])
            h = np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64)
            for at in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (h, rep)], ["h", "rep"])
        release_memory()

    once = texts.select("rep", "text").mapInArrow(shingles, "h long, rep long").groupBy("h").agg(F.count("*").alias("n"), F.min("rep").alias("rep"))
    several = texts.groupBy("rep").count().where("count > 1")
    return once.where("n = 1").groupBy("rep").agg(F.count("*").alias("lone")).join(several, "rep", "left_anti")


def alike(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts (rep, text) have that Jaccard similarity of shingles or more, counted exactly."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, x = None, set()
        for batch in batches:
            ok = []
            for one, other in zip(batch["one"].to_pylist(), batch["other"].to_pylist()):
                if one != before:
                    before, x = one, shingle_set(one, width)
                y = shingle_set(other, width)
                both = len(x & y)
                ok.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], ["a", "b"])
        release_memory()

    rows = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("one")), "a")
    rows = rows.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("other")), "b")
    return rows.select("a", "b", "one", "other").mapInArrow(compare, "a long, b long").distinct()


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id, text_hash, component_id: classes of documents that pairs of that Jaccard similarity of
    their shingles of `width` words, or more, connect.

    Candidates are pairs that the Gray-order tree finds within APART bits on one of TABLES SimHash codes of their shingles and that
    the longer fingerprint does not rule out; each is linked only when its texts have the similarity.  First every document is
    compared with a few smallest ones of those that near codes connect it to, then with a few of other classes whose fingerprints are as near as such texts' are, and then all
    candidates of different classes are, but those that shingles of one document alone keep below the similarity.

    Null texts count as empty; rows with a null id are reported with the class of equal texts but link nothing; repeated
    rows are repeated; an empty table gives an empty result; other columns are ignored.
    """

    @F.pandas_udf("array<bigint>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        signer = Signer(width)
        for texts in batches:
            yield pd.Series(list(signer.sign(texts.tolist())), dtype=object)
            release_memory()

    text, most = F.coalesce(F.col(text_col), F.lit("")), bits_at(similarity)
    docs = small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = write_table(docs.select("doc_id", "text_hash", sign("text").alias("s")), "signatures")
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    distinct = write_table(rows.where("doc_id is not null").groupBy("s").agg(first).select("s", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("text_hash")), "signed")

    def few(pairs: DataFrame) -> DataFrame:
        """Of the pairs of each b, up to four: with the smallest and largest a, and two by a hash."""
        mixed = F.xxhash64("a", "b")
        some = pairs.groupBy("b").agg(F.min("a"), F.max("a"), F.min_by("a", mixed), F.max_by("a", mixed)).toDF("b", "w", "x", "y", "z")
        return some.select(F.explode(F.array_distinct(F.array("w", "x", "y", "z"))).alias("a"), "b")

    def classed() -> DataFrame:
        parts = components(linked.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        return met.join(parts, F.col("rep") == F.col("node"), "left").select("rep", "s", F.coalesce("component", "rep").alias("part"))

    index = code_index(distinct)
    pairs = write_table(candidates(distinct, most, index=index), "candidates")
    met = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    met = write_table(distinct.join(met, "rep"), "met")
    own = met.select(F.col("rep").alias("doc_id"), "text_hash").distinct()
    texts = write_table(docs.join(own, ["doc_id", "text_hash"]).select(F.col("doc_id").alias("rep"), "text").distinct(), "near-texts")
    compared = write_table(few(pairs), "few")
    linked = write_table(alike(compared, texts, width, similarity), "alike")
    for deviations in NEARER:
        near = few(candidates(classed(), bits_at(similarity, 64 * ALL_CHECKS, deviations), every=True, checks=ALL_CHECKS, index=index))
        again = write_table(near.join(compared, ["a", "b"], "left_anti"), "few")
        compared, linked = compared.unionByName(again), linked.unionByName(write_table(alike(again, texts, width, similarity), "alike"))
    lone = write_table(lone_shingles(texts, width), "lone")
    apart = classed().join(lone, "rep", "left").withColumn("lone", F.coalesce("lone", F.lit(0)))
    rest = candidates(apart, bits_at(similarity, 64 * ALL_CHECKS), every=True, checks=ALL_CHECKS, similarity=similarity, index=index)
    rest = write_table(rest.join(compared, ["a", "b"], "left_anti"), "candidates")
    linked = linked.unionByName(alike(rest, texts, width, similarity))
    parts = components(linked.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    classes = distinct.join(parts, F.col("rep") == F.col("node"), "left").select("s", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(classes, "s", "left").select("doc_id", "text_hash", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """df with one document of each class of near duplicates, the one with the smallest id; columns unchanged.

    Null and empty texts are equal and so one class; rows with a null id stay; rows that repeat id and text stay or go
    together; ties cannot arise, since ids of one class differ or name equal rows; an empty table stays empty.
    """
    gone_id, gone_hash = unused(df, "gone_id", "gone_hash")
    found = write_table(similar_documents(df, id_col, text_col, width, similarity), "similar")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct()
    return df.join(gone, (df[id_col] == F.col(gone_id)) & (F.xxhash64(F.coalesce(df[text_col], F.lit(""))) == F.col(gone_hash)), "left_anti")

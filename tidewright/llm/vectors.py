"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Vectors of one label (and length) are compared by cosine.  Equal vectors are folded into one first; the rest are dealt
to shards of bounded size, each shard builds its graph once and stores it with its vectors in a table on the shared
folder.  Every shard's vectors then query every shard of the label (each pair of shards once, hits count for both ends).
A query walks down the levels and runs a beam on the lowest; a beam that ends full of links is widened until it is not.
Each pair of shards audits its recall against exact comparisons, of evenly spaced queries and of queries that had hits,
and widens all beams until every link of the audit is found.  Where the audit sees fewer than `SEEN` links it settles
nothing, so all queries of the pair are audited (one pass of matrix products, about a tenth of the search's time).  Hits
are verified in double precision, on vectors scaled by their largest component first, so no finite vector overflows.
Links are counted in the task; only enough links to join the classes go on to the connected components.  `recalls` gives
the audits: for each pair of shards the queries and links compared, the recall and the beam it took.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null
label, link with nothing; rows that repeat an id are vectors of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, write_table

THRESHOLD = 0.93
#: Vectors in a shard (about), links of a node above and on the lowest level, beams for building and searching.
SHARD, LINKS, LINKS_LOW, BUILD_BEAM, BEAM = 16_384, 16, 32, 48, 48
#: Queries of each kind that a pair of shards audits, the links they must show, and the recall they must reach.
AUDITS, SEEN, RECALL = 128, 256, 1.0
BATCH = 256


def _choose(base: np.ndarray, pool: np.ndarray, sims: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """For each row of base vectors, up to `most` neighbours of its pool (ids, -1 for none, best first), spread out: one
    that is closer to a neighbour taken before than to the base waits, and fills up what is left."""
    n, width = pool.shape
    order = np.argsort(-sims, axis=1, kind="stable")
    pool, sims = np.take_along_axis(pool, order, 1), np.take_along_axis(sims, order, 1)
    v = x[np.maximum(pool, 0)]
    among = v @ v.transpose(0, 2, 1)
    real = pool >= 0
    taken = np.zeros((n, width), bool)
    closest = np.full((n, width), -2.0, np.float32)
    for k in range(width):
        ok = real[:, k] & (closest[:, k] < sims[:, k]) & (taken.sum(1) < most)
        taken[:, k] = ok
        closest = np.where(ok[:, None], np.maximum(closest, among[:, k]), closest)
    rank = np.where(taken, 0, np.where(real, 1, 2)) * width + np.arange(width)
    keep = np.argsort(rank, axis=1)[:, :most]
    out = np.where(np.take_along_axis(real, keep, 1), np.take_along_axis(pool, keep, 1), -1)
    if out.shape[1] < most:
        out = np.concatenate([out, np.full((n, most - out.shape[1]), -1)], axis=1)
    return out.astype(np.int32)


def beam_search(q: np.ndarray, x: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int, threshold: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beam search of all rows of q at once.  Returns the beams' ids and similarities, best first, and a (row, id) array of
    all points met at `threshold` or above."""
    n, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n, len(x)), bool)
    ids = np.full((n, beam), -1, np.int64)
    sims = np.full((n, beam), -np.inf, np.float32)
    open_ = np.zeros((n, beam), bool)
    hits = []
    wave = max(2, beam // 12)
    new = entry
    while True:
        # of the points named, those real, not seen and named once
        real = (new >= 0) & ~seen[rows, np.maximum(new, 0)]
        r, c = np.nonzero(real)
        at = new[r, c]
        if len(at):
            _, once = np.unique(r * len(x) + at, return_index=True)
            r, c, at = r[once], c[once], at[once]
        seen[r, at] = True
        s = np.einsum("ij,ij->i", q[r], x[at]) if len(at) else np.zeros(0, np.float32)
        if threshold is not None and len(at):
            good = s >= threshold
            hits.append(np.stack([r[good], at[good]], axis=1))
        if len(at):
            fresh_s, fresh_i = np.full(new.shape, -np.inf, np.float32), np.full(new.shape, -1, np.int64)
            fresh_s[r, c], fresh_i[r, c] = s, at
            all_s, all_i = np.concatenate([sims, fresh_s], 1), np.concatenate([ids, fresh_i], 1)
            all_o = np.concatenate([open_, fresh_i >= 0], 1)
            best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sims, ids, open_ = (np.take_along_axis(y, best, 1) for y in (all_s, all_i, all_o))
        if not open_.any():
            break
        rank = np.where(open_, sims, -np.inf)
        pick = np.argpartition(-rank, min(wave, beam) - 1, axis=1)[:, :wave]
        ok = np.take_along_axis(open_, pick, 1)
        np.put_along_axis(open_, pick, False, 1)
        nodes = np.where(ok, np.take_along_axis(ids, pick, 1), -1)
        new = np.where((nodes >= 0)[:, :, None], links[np.maximum(nodes, 0)], -1).reshape(n, -1).astype(np.int64)
    order = np.argsort(-sims, axis=1)
    found = np.concatenate(hits) if hits else np.zeros((0, 2), np.int64)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), found


class Graph:
    """Levels from the top down: the members of each (places in x) and their links (numbers within the level)."""

    def __init__(self, x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.levels = x, levels

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 1) -> Graph:
        """x: unit vectors (float32).  Each level is built by inserting its members in random order, batch by batch."""
        rng = np.random.default_rng(seed)
        height = np.minimum(np.floor(-np.log(1 - rng.random(len(x))) / np.log(LINKS)), 8).astype(int)
        top = 0
        while (height > top).sum() > 32:
            top += 1
        graph = cls(x, [])
        for level in range(top, -1, -1):
            graph._add(np.flatnonzero(height >= level) if level else np.arange(len(x)), rng, LINKS if level else LINKS_LOW)
        return graph

    def _entry(self, q: np.ndarray, many: int) -> np.ndarray:
        """Places in x where a search on the next lower level starts."""
        at = np.broadcast_to(np.arange(min(64, len(self.levels[0][0]))), (len(q), min(64, len(self.levels[0][0]))))
        for k, (members, links) in enumerate(self.levels):
            ids, _, _ = beam_search(q, self.x[members], links, at, many)
            ids = np.where(ids >= 0, members[np.maximum(ids, 0)], -1)
            if k + 1 == len(self.levels):
                return ids
            below = self.levels[k + 1][0]
            at = np.where(ids >= 0, np.searchsorted(below, np.maximum(ids, 0)), -1)
        return at

    def _add(self, members: np.ndarray, rng: np.random.Generator, most: int) -> None:
        x = self.x[members]
        links = np.full((len(members), most), -1, np.int32)
        order = rng.permutation(len(members))
        done, size = 0, 32
        first = order[:size]
        while done < len(order):
            own = order[done : done + size]
            q = x[own]
            if done:
                start = np.broadcast_to(first[:8], (len(own), min(8, len(first))))
                if self.levels:
                    above = self._entry(q, 8)
                    above = np.where(above >= 0, np.searchsorted(members, np.maximum(above, 0)), -1)
                    # the points above are members here, but perhaps not linked yet
                    start = np.concatenate([np.where(np.isin(above, order[:done]), above, -1), start], axis=1)
                ids, sims, _ = beam_search(q, x, links, start, BUILD_BEAM)
            else:
                ids, sims = np.full((len(own), 1), -1, np.int64), np.full((len(own), 1), -np.inf, np.float32)
            near = q @ q.T
            np.fill_diagonal(near, -np.inf)
            k = min(most, len(own) - 1)
            if k > 0:
                peers = np.argpartition(-near, k - 1, axis=1)[:, :k]
                ids, sims = np.concatenate([ids, own[peers]], 1), np.concatenate([sims, np.take_along_axis(near, peers, 1)], 1)
            chosen = _choose(q, ids, sims, x, most)
            links[own] = chosen
            # links back, the receiver keeps the best spread of old and new
            src, dst = np.repeat(own, most), chosen.ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            score = np.einsum("ij,ij->i", x[src], x[dst])
            by = np.lexsort((-score, dst))
            src, dst = src[by], dst[by]
            to, begin, many = np.unique(dst, return_index=True, return_counts=True)
            place = np.arange(len(dst)) - np.repeat(begin, many)
            fit = place < most
            pool = np.full((len(to), most), -1, np.int64)
            pool[np.repeat(np.arange(len(to)), many)[fit], place[fit]] = src[fit]
            pool[(pool[:, :, None] == links[to][:, None, :]).any(2)] = -1
            pool = np.concatenate([links[to].astype(np.int64), pool], axis=1)
            for at in range(0, len(to), 512):
                part, p = to[at : at + 512], pool[at : at + 512]
                s = np.where(p >= 0, np.einsum("ijk,ik->ij", x[np.maximum(p, 0)], x[part]), -np.inf).astype(np.float32)
                links[part] = _choose(x[part], p, s, x, most)
            done += len(own)
            size = min(BATCH, max(32, done))
        self.levels.append((members, links))

    def near(self, q: np.ndarray, threshold: float, beam: int) -> np.ndarray:
        """(row, place) of points found at the threshold or above; full beams are widened."""
        out = []
        todo, width = np.arange(len(q)), min(beam, len(self.x))
        while len(todo):
            full, step = [], max(8, min(BATCH, BATCH * BEAM // width))
            for at in range(0, len(todo), step):
                own = todo[at : at + step]
                start = self._entry(q[own], min(8, len(self.x)))
                ids, sims, hits = beam_search(q[own], self.x, self.levels[-1][1], start, width, threshold)
                busy = (sims[:, -1] >= threshold) & (width < len(self.x))
                full.append(own[busy])
                hits = hits[~busy[hits[:, 0]]]
                out.append(np.stack([own[hits[:, 0]], hits[:, 1]], axis=1))
            todo, width = np.concatenate(full), min(2 * width, len(self.x))
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def build_shard(ids: np.ndarray, many: np.ndarray, vectors: np.ndarray) -> bytes:
    order = np.argsort(ids)
    unit = _unit(vectors[order].astype(np.float64))
    graph = Graph.build(unit.astype(np.float32))
    levels = {f"m{k}": m for k, (m, _) in enumerate(graph.levels)} | {f"l{k}": x for k, (_, x) in enumerate(graph.levels)}
    return _pack(ids=ids[order], many=many[order], vectors=vectors[order], **levels)


def _load(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    z = np.load(io.BytesIO(blob))
    unit = _unit(z["vectors"].astype(np.float64))
    n = sum(k[0] == "l" for k in z.files)
    return z["ids"], z["many"], unit, Graph(unit.astype(np.float32), [(z[f"m{k}"], z[f"l{k}"]) for k in range(n)])


def shard_links(a: bytes, b: bytes, same: bool, threshold: float = THRESHOLD, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float, tuple[int, int, int]]:
    """Links between two shards: rows and places of the pairs, ids and copies of both sides' vectors, audited recall, and the audit's
    queries and links and the beam."""
    ids_a, many_a, unit_a, _ = _load(a)
    ids_b, many_b, unit_b, graph = (ids_a, many_a, unit_a, _load(a)[3]) if same else _load(b)
    slack = 1e-4  # single precision, before the check in double precision
    query, base, n = unit_a.astype(np.float32), unit_b.astype(np.float32), len(ids_b)

    def verified(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Keys of the pairs that are links, each once."""
        good = np.einsum("ij,ij->i", unit_a[r], unit_b[c]) >= threshold
        r, c = r[good], c[good]
        if same:
            r, c = np.minimum(r, c)[r != c], np.maximum(r, c)[r != c]
        return np.unique(r.astype(np.int64) * n + c)

    def exact(rows: np.ndarray) -> np.ndarray:
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(rows), BATCH):
            own = rows[at : at + BATCH]
            r, c = np.nonzero(query[own] @ base.T >= threshold - slack)
            found.append(verified(own[r], c))
        return np.unique(np.concatenate(found))

    spaced = lambda rows: rows[np.unique(np.linspace(0, len(rows) - 1, min(AUDITS, len(rows))).astype(int))] if len(rows) else rows
    want = None
    while True:
        hits = graph.near(query, threshold - slack, beam)
        key = verified(hits[:, 0], hits[:, 1])
        if want is None:
            rows = np.unique(np.r_[spaced(np.arange(len(ids_a))), spaced(np.unique(key // n))])
            want = exact(rows)
            if len(want) < SEEN and len(rows) < len(ids_a):
                rows = np.arange(len(ids_a))
                want = exact(rows)
        recall = float(np.isin(want, key).mean()) if len(want) else 1.0
        key = np.union1d(key, want)  # what the audit knows is no less a link
        if recall >= RECALL or beam >= n:
            if recall < RECALL:  # no beam reaches the rest of the graph
                key = exact(np.arange(len(ids_a)))
            r, c = key // n, key % n
            return r, c, ids_a, ids_b, np.stack([many_a[r], many_b[c]]) if len(r) else np.zeros((2, 0), np.int64), recall, (len(rows), len(want), beam)
        beam *= 2


def _compare(df: DataFrame, id_col: str, vector_col: str, label_col: str, threshold: float, shard: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The vectors, the classes of equal ones, and what the pairs of shards found; all stored."""
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = write_table(rows.withColumn("fine", fine), "vectors")
    classes = rows.where("fine and vec_id is not null").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")).withColumn("dim", F.size("v"))
    classes = write_table(classes, "classes")
    counts = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).alias("shards"))
    dealt = classes.join(counts, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), "shards").cast("int"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        blob = build_shard(part["rep"].to_numpy(), part["many"].to_numpy(), np.stack(part["v"].to_numpy()))
        return part[["label", "dim", "shard"]].iloc[:1].assign(blob=blob)

    kind = df.schema[label_col].dataType.simpleString()
    graphs = dealt.select("label", "dim", "shard", "rep", "many", "v").groupBy("label", "dim", "shard").applyInPandas(build, f"label {kind}, dim int, shard int, blob binary")
    graphs = write_table(graphs, "graphs")
    keys = graphs.select("label", "dim", "shard")
    pairs = keys.join(keys.withColumnRenamed("shard", "shard_b"), ["label", "dim"]).where("shard <= shard_b")  # of shards, without their vectors
    other = graphs.select("label", "dim", F.col("shard").alias("shard_b"), F.col("blob").alias("blob_b"))
    pairs = pairs.join(graphs, ["label", "dim", "shard"])
    both = ["label", "dim", "shard_b"]
    pairs = pairs.where("shard = shard_b").withColumn("blob_b", F.lit(None).cast("binary")).unionByName(pairs.where("shard < shard_b").join(other, both))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .simhash import _merge

        blank = dict.fromkeys(("shard", "shard_b", "queries", "seen", "recall", "beam"))
        for b in batches:
            for blob, blob_b, one, two in zip(b["blob"], b["blob_b"], b["shard"], b["shard_b"]):
                r, c, ids_a, ids_b, many, recall, (rows, seen, beam) = shard_links(blob, blob_b, one == two, threshold)
                yield pd.DataFrame({"rep": pd.array([None], "Int64"), "other": pd.array([None], "Int64"), "n": 0, "shard": one, "shard_b": two, "queries": rows, "seen": seen, "recall": recall, "beam": beam})
                count_a = np.bincount(r, many[1], len(ids_a)).astype(np.int64)
                count_b = np.bincount(c, many[0], len(ids_b)).astype(np.int64)
                counted = pd.DataFrame({"rep": np.r_[ids_a, ids_b], "n": np.r_[count_a, count_b]}).query("n > 0")
                yield counted.assign(other=pd.array([None] * len(counted), "Int64"), **blank)
                if len(r):  # a forest that joins what the links join
                    if one == two:
                        label = _merge(np.arange(len(ids_a)), r, c)
                        ids, at = ids_a, np.flatnonzero(label != np.arange(len(label)))
                    else:
                        label = _merge(np.arange(len(ids_a) + len(ids_b)), r, c + len(ids_a))
                        ids, at = np.r_[ids_a, ids_b], np.flatnonzero(label != np.arange(len(label)))
                    yield pd.DataFrame({"rep": ids[at], "other": pd.array(ids[label[at]], "Int64"), "n": 0}).assign(**blank)

    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = "rep long, other long, n long, shard int, shard_b int, queries long, seen long, recall double, beam int"
    found = pairs.repartition(parts, "label", "dim", "shard", "shard_b").select("shard", "shard_b", "blob", "blob_b").mapInPandas(search, schema)
    return rows, classes, write_table(found, "links")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows, classes, found = _compare(df, id_col, vector_col, label_col, threshold, shard)
    links = found.where("rep is not null and other is null").groupBy("rep").agg(F.sum("n").alias("n"))
    joined = components(found.where("other is not null").select(F.col("rep").alias("src"), F.col("other").alias("dst")))
    told = classes.select("label", "v", "rep", "many").join(links, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    told = told.select(F.col("label").alias("l"), F.col("v").alias("w"), (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(told, F.col("fine") & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def recalls(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """One row per pair of shards: shard, shard_b, queries, seen (links that their exact comparison shows), recall, beam."""
    found = _compare(df, id_col, vector_col, label_col, threshold, shard)[2]
    return found.where("recall is not null").select("shard", "shard_b", "queries", "seen", "recall", "beam")

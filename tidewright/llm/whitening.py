"""Embedding whitening by hierarchical merging of singular value decompositions.

Entries become whole numbers first, x = floor(scale * c) + shift, so counts and sums are exact.  Each partition centres its
vectors and keeps the full decomposition: all singular values, all right vectors, the mean, and the exact count and sums.
Two states are merged by stacking their scaled right vectors and one more row, the difference of the means times the root of
n1 n2 / (n1 + n2), and decomposing again; nothing is cut off, so the merged state is that of all rows.  States merge in a
tree: each level is written to the shared folder, a task holds two states and what it merges into, each of the size of the
dimension squared.  The covariance of n rows has the squared singular values over n as its variances.

Vectors of different lengths lie in different spaces: each length is fitted apart.  The driver reads one model a length: sums
and `most` components, never rows.

Defined results: a vector that is null, empty, or holds a null or non-finite entry, or one whose whole number has more than
46 bits, is left out; repeated rows count as often as they occur; components without variance (below the rounding of the
decomposition) have a null whitened value, explained 0 and no part in identity_error, which is null where no component has any;
an empty table gives an empty result; other columns of the input are ignored.  The sign of a component makes its largest entry
positive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, write_table

SCALE, SHIFT, MOST = 1024, 100_000, 8
#: Bits of a whole number; sums of a batch of rows stay exact in 64 bits.
BITS = 46
#: States that one task merges, bounded by bytes as well.
FAN_IN, FAN_BYTES = 16, 64 << 20
#: Rows are decomposed together once they take so many bytes, and are as many as their length.
WAIT_BYTES = 16 << 20
_STATE = "dim int, part long, n long, total array<decimal(38,0)>, mean array<double>, s array<double>, v array<double>"


@dataclass
class State:
    """Of n rows: exact sums, mean, singular values and right vectors (rows of v) of the centred rows."""

    n: int
    total: np.ndarray  # Python ints
    s: np.ndarray
    v: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([int(t) / self.n for t in self.total])

    @classmethod
    def of(cls, x: np.ndarray) -> State:
        """The state of rows of whole numbers."""
        total = x.sum(0)
        state = cls(len(x), np.array([int(t) for t in total], object), np.zeros(0), np.zeros((0, x.shape[1])))
        return state._decomposed(x - state.mean)

    def _decomposed(self, rows: np.ndarray) -> State:
        if len(rows) > 2 * rows.shape[1]:
            rows = np.linalg.qr(rows, mode="r")
        _, self.s, self.v = np.linalg.svd(rows, full_matrices=False)
        return self

    def merge(self, other: State) -> State:
        """The state of both states' rows."""
        n = self.n + other.n
        between = math.sqrt(self.n * other.n / n) * (self.mean - other.mean)
        rows = np.vstack([self.s[:, None] * self.v, other.s[:, None] * other.v, between[None]])
        return State(n, self.total + other.total, self.s, self.v)._decomposed(rows)

    def row(self, dim: int, part: int) -> dict:
        return {"dim": dim, "part": part, "n": self.n, "total": [Decimal(int(t)) for t in self.total], "mean": self.mean, "s": self.s, "v": self.v.ravel()}

    @classmethod
    def read(cls, row) -> State:
        dim = int(row.dim)
        return cls(int(row.n), np.array([int(t) for t in row.total], object), np.asarray(row.s, float), np.asarray(row.v, float).reshape(-1, dim))


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, dim, x: the vectors that count, as whole numbers."""
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("c"))
    bound = float(1 << BITS) / 2
    fine = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < bound))
    rows = rows.where(F.col("c").isNotNull() & (F.size("c") > 0) & fine)
    return rows.select("vec_id", F.size("c").alias("dim"), F.transform("c", lambda c: F.floor(c * scale) + shift).alias("x"))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a batch (dim, x): each length, its places in the batch and its vectors."""
    dims = batch.column("dim").to_numpy()
    lists = batch.column("x")
    flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, flat[offsets[at][:, None] + np.arange(dim)]


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, states, waiting = TaskContext.get().partitionId(), {}, {}

    def take(dim: int) -> None:
        state = State.of(np.concatenate(waiting.pop(dim)))
        states[dim] = states[dim].merge(state) if dim in states else state

    for batch in batches:
        for dim, _, x in _by_dim(batch):
            waiting.setdefault(dim, []).append(x)
            if sum(map(len, waiting[dim])) >= max(dim, WAIT_BYTES // (8 * dim)):
                take(dim)
    for dim in list(waiting):
        take(dim)
    for dim, state in states.items():
        yield _batch([state.row(dim, part)])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.decimal128(38, 0))), ("mean", pa.list_(pa.float64())), ("s", pa.list_(pa.float64())), ("v", pa.list_(pa.float64()))])
    return pa.RecordBatch.from_pylist([{k: list(v) if isinstance(v, np.ndarray) else v for k, v in r.items()} for r in rows], schema)


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    """One state of the states of a group, merged in the order of their parts."""
    dim, group = (k.as_py() for k in key)
    state = None
    for batch in table.sort_by("part").to_batches(max_chunksize=1):
        one = State.read(batch.to_pandas().iloc[0])
        state = one if state is None else state.merge(one)
    return pa.Table.from_batches([_batch([state.row(dim, group)])])


def fit(x: DataFrame) -> DataFrame:
    """x (dim, x) to a stored table of one state a length: dim, part, n, total, mean, s, v (right vectors, one after another)."""
    states = write_table(x.select("dim", "x").mapInArrow(_states, _STATE), "whitening")
    while True:
        widths = states.agg(F.max("part"), F.max("dim")).first()
        if not widths[0]:
            return states
        fan = max(2, min(FAN_IN, FAN_BYTES // (8 * widths[1] * widths[1])))
        grouped = states.withColumn("group", F.floor(F.col("part") / fan)).groupBy("dim", "group")
        states = write_table(grouped.applyInArrow(_merged, _STATE), "whitening")


@dataclass(frozen=True)
class Model:
    """Of one length: count, exact sums, components (rows), their variances, and the sum of all variances."""

    n: int
    total: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float


def models(states: DataFrame, most: int = MOST) -> dict[int, Model]:
    """A model a length, read by the driver: `most` components of each."""
    cut = states.select("dim", "n", "total", "s", F.slice("v", F.lit(1), F.col("dim") * most).alias("v"))
    out = {}
    for row in cut.collect():  # a row a length
        s, v = np.array(row["s"]), np.array(row["v"]).reshape(-1, row["dim"])
        sign = np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])
        real = s > np.finfo(float).eps * max(row["n"], row["dim"]) * s.max(initial=0.0)
        e = np.where(real, s * s / row["n"], 0.0)
        k = min(most, row["dim"])
        components, variances = np.zeros((k, row["dim"])), np.zeros(k)
        components[: len(v)], variances[: min(k, len(e))] = (v * sign[:, None])[:k], e[:k]
        out[row["dim"]] = Model(row["n"], tuple(int(t) for t in row["total"]), components, variances, float(e.sum()))
    return out


def _deviation(x: np.ndarray, m: Model) -> list[Decimal | None]:
    """The sum over dimensions of (n x - S) squared, exact; None beyond 38 digits."""
    largest = max(m.n * int(np.abs(x).max()), *map(abs, m.total))
    span = max(m.n * int(x.max()) - min(m.total), max(m.total) - m.n * int(x.min()))
    kind = np.int64 if largest < 1 << 62 and span * span * x.shape[1] < 1 << 62 else object
    off = m.n * x.astype(kind) - np.array(m.total, kind)
    return [Decimal(d) if d < 10**38 else None for d in map(int, (off * off).sum(1))]


def project(x: DataFrame, fitted: dict[int, Model]) -> DataFrame:
    """vec_id, dim, deviation (decimal), w: the whitened values, one a component (null without variance)."""
    spec = x.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, rows in _by_dim(batch):
                m = fitted[dim]
                mean = np.array([t / m.n for t in m.total])
                has = m.variances > 0
                w = ((rows - mean) @ m.components.T) / np.sqrt(np.where(has, m.variances, 1.0))
                values = pa.array([[v if h else None for v, h in zip(r, has)] for r in w.tolist()], pa.list_(pa.float64()))
                ids = batch.column("vec_id").take(pa.array(at))
                dims = pa.array(np.full(len(at), dim, np.int32))
                yield pa.RecordBatch.from_arrays([ids, dims, pa.array(_deviation(rows, m), pa.decimal128(38, 0)), values], ["vec_id", "dim", "deviation", "w"])

    return x.mapInArrow(run, f"vec_id {spec}, dim int, deviation decimal(38,0), w array<double>")


def identity_errors(projected: DataFrame, most: int = MOST) -> DataFrame:
    """dim, identity_error: the largest absolute entry of the whitened values' covariance minus the identity."""
    at = lambda k: F.get("w", F.lit(k))
    pairs = [F.abs(F.covar_pop(at(a), at(b)) - (1.0 if a == b else 0.0)) for a in range(most) for b in range(a, most)]
    named = projected.groupBy("dim").agg(*[p.alias(f"p{k}") for k, p in enumerate(pairs)])
    return named.select("dim", F.array_max(F.array(*[f"p{k}" for k in range(len(pairs))])).alias("identity_error"))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """A row a vector and component: vec_id, component (from 1), n, deviation (decimal), whitened, explained, identity_error."""
    if most < 1:
        raise ValueError("at least one component")
    x = small_batches(vectors(df, id_col, vector_col, scale, shift))
    fitted = models(fit(x), most)
    projected = write_table(project(x, fitted), "whitened")
    share = [(dim, m.n, [float(e / m.trace) if m.trace else 0.0 for e in m.variances]) for dim, m in fitted.items()]
    told = df.sparkSession.createDataFrame(share, "dim int, n long, shares array<double>").join(identity_errors(projected, most), "dim", "left")
    rows = projected.join(F.broadcast(told), "dim")  # a row a length
    rows = rows.select("vec_id", "n", "deviation", "shares", "identity_error", F.posexplode("w").alias("k", "whitened"))
    return rows.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", F.get("shares", F.col("k")).alias("explained"), "identity_error")

"""Periodic runs of words by the divide and conquer of Main and Lorentz, on interned word ids.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring word
extends, at least `COPIES` periods and `LEAST` words long.  The words of a batch of texts are interned to numbers, then
every text is halved again and again.  A run is found at the first midpoint that lies inside it: it is inside that
segment, and on one side of the midpoint it covers two periods.  So the Z-function of that side (of the right half, or of
the left half read backwards) names the period: z[q] >= q.  The match is extended over the midpoint and to both ends; an
interval found with several periods keeps the smallest; one that goes on beyond the segment belongs to a segment above.

All segments of one level are looked at together: the distance to the next equal word tells which midpoints can have a
period at all, and only those get Z-functions, whose values are worked out at the places that repeat the first word (they
are 0 elsewhere).  No text is cut and no period is left out; work is n log n words.

A text is handled whole inside one task; batches are bounded by Arrow's rows and bytes, and several short texts share one
pass.  Defined results: null and empty texts have no runs and an empty collapsed text; rows that repeat an id, or have a
null one, are texts of their own; other columns of the input pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unused

#: Periods that a run covers at least, and its least number of words.
COPIES, LEAST = 4, 6


def common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries of a and b agree; looked at in blocks that double."""
    n = min(len(a), len(b))
    done, step = 0, 16
    while done < n:
        part = a[done : done + step] != b[done : done + step][: n - done]
        if part.any():
            return done + int(part.argmax())
        done += len(part)
        step *= 2
    return n


def z_function(w: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """The places 1..upto that repeat w[0], and how many words from there agree with the start (all others have 0)."""
    at = np.flatnonzero(w[1 : upto + 1] == w[0]) + 1
    z = np.zeros(upto + 1, np.int64)
    left = right = 0  # the rightmost match so far
    n = len(w)
    for i in at.tolist():
        k = min(right - i, int(z[i - left])) if i < right else 0
        if i + k >= right:
            k += common_prefix(w[i + k :], w[k : n - i]) if i + k < n else 0
            left, right = i, i + k
        z[i] = k
    return at, z[at]


def _crossing(w: np.ndarray, m: int, copies: int, least: int, before: int, after: int, found: dict[tuple[int, int], int]) -> None:
    """Runs of the segment w that reach over, or start or end at, its midpoint m, into found (start, length): period.

    before and after are 0 where the text ends with the segment; else runs that the next words would extend are left out.
    """
    n = len(w)
    limit = n // copies
    for back in (False, True):
        half = w[:m][::-1] if back else w[m:]
        other = w[m:] if back else w[:m][::-1]
        at, z = z_function(half, min(limit, len(half) - 1))
        twice = z >= at  # two periods on this side
        covered = 0  # of this side, by a smaller period: what repeats twice inside of that is the same stretch
        for q, k in zip(at[twice].tolist(), z[twice].tolist()):
            if 2 * q <= covered:
                continue
            covered = max(covered, q + k)
            # the other side goes on while its words equal those q further on, first in this half, then in itself
            start = half[:q][::-1]
            reach = common_prefix(other[:q], start)
            if reach == q:
                reach += common_prefix(other[q:], other)
            length = reach + q + k
            if length < max(least, copies * q):
                continue
            begin = m - (q + k) if back else m - reach
            ends_left = begin > 0 or not before
            ends_right = begin + length < n or not after
            if not ends_left and w[begin + q - 1] != before:
                ends_left = True
            if not ends_right and w[begin + length - q] != after:
                ends_right = True
            if ends_left and ends_right:
                key = (begin, length)
                if found.get(key, q + 1) > q:
                    found[key] = q


def batch_runs(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, copies: int = COPIES, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """For each text ids[start:end] (ids from 1): its runs (start, length, period) by start, then period."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in starts]
    if len(ids):
        order = np.argsort(ids, kind="stable")
        same = ids[order][1:] == ids[order][:-1]
        ahead = np.full(len(ids) + 1, len(ids) + 1, np.int64)  # distance to the next equal word
        ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
        behind = np.full(len(ids) + 1, len(ids) + 1, np.int64)
        behind[order[1:][same]] = (order[1:] - order[:-1])[same]
        low, high, owner = starts.astype(np.int64), ends.astype(np.int64), np.arange(len(starts))
        while True:
            wide = high - low >= least
            low, high, owner = low[wide], high[wide], owner[wide]
            if not len(low):
                break
            mid = (low + high) // 2
            limit = (high - low) // copies
            # two periods to the right of the midpoint: its word and the next one come again within the longest period; so to the left
            right = np.maximum(ahead[mid], ahead[np.minimum(mid + 1, len(ids))]) <= limit
            left = np.maximum(behind[mid - 1], behind[np.maximum(mid - 2, 0)]) <= limit
            for k in np.flatnonzero(right | left).tolist():
                lo, hi, o = int(low[k]), int(high[k]), int(owner[k])
                inside: dict[tuple[int, int], int] = {}
                before = int(ids[lo - 1]) if lo > starts[o] else 0
                after = int(ids[hi]) if hi < ends[o] else 0
                _crossing(ids[lo:hi], int(mid[k]) - lo, copies, least, before, after, inside)
                shift = lo - int(starts[o])
                for (begin, length), q in inside.items():
                    key = (begin + shift, length)
                    if found[o].get(key, q + 1) > q:
                        found[o][key] = q
            low, high, owner = np.concatenate([low, mid]), np.concatenate([mid, high]), np.concatenate([owner, owner])
    return [sorted((s, n, q) for (s, n), q in f.items()) for f in found]


def collapse(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    drop = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return np.cumsum(drop[:n]) == 0


def periodic_runs(df: DataFrame, text_col: str = "text", copies: int = COPIES, least: int = LEAST) -> DataFrame:
    """df without its text, with runs (start, length, period: array of structs), n_tokens and collapsed (words joined by one space)."""
    if copies < 4 or least < 5:
        raise ValueError("the search needs four copies and five words at least")
    kept = [c for c in df.columns if c != text_col]
    own = unused(df, "runs", "n_tokens", "collapsed")
    inner = [f"_c{k}" for k in range(len(kept))]
    rows = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(kept, inner)], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))

    @F.pandas_udf("runs array<struct<start:long,length:long,period:long>>, n_tokens long, collapsed string")
    def find(texts: pd.Series) -> pd.DataFrame:
        words = [t.encode().split() for t in texts]  # bytes split at ASCII white space only
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for ws in words for w in ws), np.int64)
        sizes = np.array([len(ws) for ws in words], np.int64)
        ends = np.cumsum(sizes)
        runs = batch_runs(ids, ends - sizes, ends, copies, least)
        out = []
        for ws, own_runs in zip(words, runs):
            if own_runs:
                stay = collapse(len(ws), own_runs)
                ws = [w for w, ok in zip(ws, stay.tolist()) if ok]
            out.append(b" ".join(ws).decode())
        return pd.DataFrame({"runs": [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], "n_tokens": sizes, "collapsed": out})

    found = small_batches(rows).select(*inner, find("_text").alias("_found"))
    return found.select(*[F.col(a).alias(c) for a, c in zip(inner, kept)], *[F.col(f"_found.{c}").alias(o) for c, o in zip(("runs", "n_tokens", "collapsed"), own)])


def longest(runs: Column) -> Column:
    """The run of greatest length; of equal ones the smallest start, then period; null without runs."""
    key = lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period"))
    best = F.array_min(F.transform(runs, key))
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["a"]).alias("length"), best["period"].alias("period")))


def listing(runs: Column) -> Column:
    """Every run as a line start,length,period."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")

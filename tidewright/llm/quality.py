"""Document quality by Bradley-Terry pairwise ranking.

The chance that one document is preferred to another is the logistic function of the difference of their scores; scores
are linear in shape features of the whole text (case, symbols, repetition, line and word shapes), each taken raw and
as a place among the quantiles of the training rows.  Weights are learned from preference pairs, a document of label 1
against one of label 0, by logistic loss on the feature differences.  Documents are kept by a quantile of the scores of
the table at hand; a calibration fitted on rows outside the fit maps a score to the chance of label 1.

The fit reads at most `MAX_LABELS` labelled rows and `PAIRS` pairs (documented bounds); features are computed on the
executors and only they reach the driver, never texts.  Every text is scored whole.  A score is summed column by column,
so it depends on its text alone and equal texts have equal scores in any batch.

Defined results: null and empty texts have all features zero; rows that repeat an id are scored each; in training an id
counts once, with its largest label and the smallest of its texts; a missing or one-sided training set gives a constant
score, the share of label 1 (0 without labels); ties at the quantile stay; an empty table gives an empty result; all other
columns are kept, but columns named rank and quality are replaced by the scores.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unused
from .toxicity import labelled

MAX_LABELS, PAIRS = 8_000, 60_000
QUANTILES = 8
#: Counts that a round of the exact quantile reads.
BINS = 1_024
#: Share of documents below the quantile that the decision asks for.
DROP_SHARE = 0.25

_ODD = re.compile(r"[^\w\s]{2,}")
FEATURES = ("words", "upper", "symbols", "digits", "spaces", "odd_runs", "odd_words", "upper_words", "same_next", "distinct", "top_word", "triples", "top_triple", "line_repeats", "short_lines", "bars", "word_length", "long_words", "ends", "packed", "letters")


def features(text: str | None) -> list[float]:
    """Shape features of a whole text, in the order of FEATURES."""
    if not text or not (words := text.split()):
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    raw = text.encode()
    counts = Counter(words)
    triples = Counter(zip(words, words[1:], words[2:]))
    lines = [x for x in text.split("\n") if x]
    upper = sum(map(str.isupper, text)) if not raw.isascii() else size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    symbols = len(raw) - len(raw.translate(None, b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"))
    spaces = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\f"))
    odd = _ODD.findall(text)
    return [
        np.log1p(n) / 10,
        upper / size,
        symbols / size,
        digits / size,
        spaces / size,
        len(odd) / n,
        sum(not (w[0].isalnum() and (w[-1].isalnum() or w[-1] in ".,;")) for w in words) / n,
        sum(map(str.isupper, words)) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        len(counts) / n,
        max(counts.values()) / n,
        len(triples) / max(1, n - 2),
        max(triples.values(), default=0) / max(1, n - 2),
        1 - len(set(lines)) / len(lines),
        sum(len(x) < 20 for x in lines) / len(lines),
        counts.get("|", 0) / n,
        sum(map(len, words)) / n / 20,
        sum(len(w) > 20 for w in words) / n,
        sum(x[-1] in ".!?" for x in lines) / len(lines),
        len(zlib.compress(raw, 1)) / len(raw),
        sum(w.isalpha() for w in words) / n,
    ]


class Ranker:
    """Weights of the score, the quantiles of each feature, and the calibration."""

    def __init__(self):
        self.edges = np.zeros((len(FEATURES), QUANTILES - 1))
        self.mean, self.scale = np.zeros(0), np.ones(0)
        self.weights = np.zeros(0)
        self.slope, self.offset = 1.0, 0.0
        self.constant: float | None = None

    def _design(self, x: np.ndarray) -> np.ndarray:
        places = [(x[:, [k]] > self.edges[k]).astype(float) for k in range(x.shape[1])]
        return np.concatenate([x, *places], axis=1)

    def rank(self, x: np.ndarray) -> np.ndarray:
        """Bradley-Terry scores of feature rows."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z, out = self._design(x), np.zeros(len(x))
        for k, weight in enumerate(self.weights.tolist()):  # in a fixed order, whatever else is in the batch
            out += (z[:, k] - self.mean[k]) / self.scale[k] * weight
        return out

    def chance(self, rank: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rank), self.constant)
        return np.array([1 / (1 + math.exp(-min(30.0, max(-30.0, self.slope * r + self.offset)))) for r in rank.tolist()])

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> Ranker:
        y = np.asarray(y)
        if len(y) < 20 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.0
            return self
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        check, train = order[: len(y) // 5], order[len(y) // 5 :]
        if y[train].min() == y[train].max():
            check, train = order[:0], order
        self.edges = np.quantile(x[train], np.linspace(0, 1, QUANTILES + 1)[1:-1], axis=0).T
        z = self._design(x[train])
        self.mean, self.scale = z.mean(0), np.maximum(z.std(0), 1e-3)
        z = (z - self.mean) / self.scale
        good, bad = np.flatnonzero(y[train] == 1), np.flatnonzero(y[train] == 0)
        pairs_a, pairs_b = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)
        w, g2 = np.zeros(z.shape[1]), np.full(z.shape[1], 1e-3)
        for _ in range(3):
            for at in range(0, PAIRS, 512):
                d = z[pairs_a[at : at + 512]] - z[pairs_b[at : at + 512]]
                g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(0) + 1e-3 * w
                g2 += g * g
                w -= 0.1 * g / np.sqrt(g2)
        self.weights = w
        own = check if len(check) and 0 < y[check].sum() < len(check) else train
        r, t = self.rank(x[own]), y[own]
        soft = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
        spread = max(r.std(), 1e-6)
        a, b, r = 1.0, 0.0, r / spread
        for _ in range(2_000):
            g = 1 / (1 + np.exp(-np.clip(a * r + b, -30, 30))) - soft
            a, b = max(0.05, a - 0.5 * (g * r).mean()), b - 0.5 * g.mean()
        self.slope, self.offset = a / spread, b
        return self


def train(docs: DataFrame, labels: DataFrame, keep: Column, limit: int = MAX_LABELS) -> Ranker:
    """A ranker fitted on the labelled rows of `labels` that `keep` lets through."""
    features_udf = F.pandas_udf(lambda texts: pd.Series([features(x) for x in texts]), "array<double>")
    rows = labelled(docs, labels, "quality", keep, limit).select("doc_id", "y", features_udf("text").alias("x")).toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return Ranker().fit(x, rows["y"].to_numpy())


def score_quality(df: DataFrame, model: Ranker) -> DataFrame:
    """df with rank (the Bradley-Terry score) and quality (0 to 1), in place of columns of these names."""

    @F.pandas_udf("struct<rank:double,quality:double>")
    def score(texts: pd.Series) -> pd.DataFrame:
        x = np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
        r = model.rank(x)
        return pd.DataFrame({"rank": r, "quality": model.chance(r)})

    (both,) = unused(df, "scores")
    out = small_batches(df).withColumn(both, score(F.coalesce(F.col("text"), F.lit(""))))
    return out.withColumn("rank", F.col(f"{both}.rank")).withColumn("quality", F.col(f"{both}.quality")).drop(both)


def rank_quantile(scored: DataFrame, share: float) -> float | None:
    """The exact `share` quantile of the ranks of a scored and stored table: the smallest rank that at least that share of all
    ranks does not exceed; None without rows.

    The range of ranks is narrowed to the bin that holds the quantile, bin by bin, so the driver reads BINS counts a round.
    """
    n, low, high = scored.agg(F.count("rank"), F.min("rank"), F.max("rank")).first()
    if not n:
        return None
    want, below = max(1, math.ceil(share * n)), 0
    while low < high:
        width = (high - low) / BINS
        place = F.least(F.floor((F.col("rank") - low) / width), F.lit(BINS - 1)).cast("int")
        if low + width <= low:  # no more than BINS numbers lie in between
            place = F.col("rank")
        bins = scored.where(F.col("rank").between(low, high)).groupBy(place.alias("bin"))
        for _, many, first, last in sorted(bins.agg(F.count("*"), F.min("rank"), F.max("rank")).collect()):
            if below + many >= want:
                low, high = first, last
                break
            below += many
    return low


def keep_best(scored: DataFrame, drop_share: float) -> DataFrame:
    """Rows of a scored (and stored) table whose rank reaches the quantile `drop_share` of all ranks; ties stay."""
    if drop_share <= 0:
        return scored
    cut = rank_quantile(scored, drop_share)
    return scored.where(F.col("rank") >= cut) if cut is not None else scored

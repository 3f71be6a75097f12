"""Toxicity scores by a convolutional text classifier in numpy, with decision thresholds calibrated by language.

A word's vector is the sum of hashed embeddings of the word, its leading characters and its ending; filters of several
widths slide over the whole text and their largest responses feed a logistic output.  Embeddings start from the word
parts' log odds in the training rows, all weights are then trained by gradient descent (through the maxima only).  The
score is calibrated on rows that the fit has not seen; there also each language gets the threshold with the best F1
(languages with few rows share one).  The language is used for that threshold only, never for a score.

The fit reads at most `MAX_LABELS` labelled rows of at most `MAX_WORDS` words together (documented bounds; a hash of the id
decides which); words become feature numbers on the executors and only these reach the driver.  Every text is scored whole.

A score depends on its text alone: what the filters answer to a word is summed dimension by dimension, elementwise, once per
distinct word; answers of neighbouring words are added in order, maxima are exact, and the output is summed filter by
filter in double precision.  So equal texts have equal scores in any batch and any partitioning.

Defined results: null and empty texts get the score of a text without words; rows that repeat an id are scored each; in
training an id counts once, with its largest label and the smallest of its texts; a missing or one-sided training set
gives a constant score, the share of positive labels (0 without labels); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory, small_batches, write_table

#: Labelled rows that a fit reads at most, and their words together.
MAX_LABELS, MAX_WORDS = 8_000, 6_000_000
BUCKETS, DIM, WIDTHS, FILTERS, PARTS = 1 << 15, 16, (1, 2, 3), 16, 6
EPOCHS, BATCH, RATE = 4, 32, 0.05
#: Words that the filters pass over at a time.
BLOCK = 20_000
#: Words remembered by a worker; it starts anew when full.
REMEMBER = 100_000
#: Texts that are scored together.
TEXTS = 1_000
#: Calibration rows that a language needs for a threshold of its own.
LANG_ROWS = 50

_EDGE = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def parts(word: str) -> list[int]:
    """Buckets of a lower-cased word's features: the word, its last three characters, its first four to seven; BUCKETS for none."""
    w = word.strip(_EDGE)
    marks = ["=" + w, "$" + w[-3:]] + [f"{n}^{w[:n]}" for n in (4, 5, 6, 7) if len(w) > n]
    out = [zlib.crc32(x.encode()) % BUCKETS for x in marks]
    return out + [BUCKETS] * (PARTS - len(out))


class Words:
    """Row numbers for distinct words, and each row's feature buckets."""

    def __init__(self):
        self.row: dict[str, int] = {}
        self.flat = array("i")

    def __len__(self) -> int:
        return len(self.row)

    def rows(self, text: str) -> np.ndarray:
        words, row = text.lower().split(), self.row
        try:
            return np.array([row[w] for w in words], np.int32)
        except KeyError:
            for w in words:
                if w not in row:
                    row[w] = len(row)
                    self.flat.extend(parts(w))
            return np.array([row[w] for w in words], np.int32)

    def parts(self, since: int = 0, upto: int | None = None) -> np.ndarray:
        return np.array(self.flat[since * PARTS : (len(self) if upto is None else upto) * PARTS], np.int32).reshape(-1, PARTS)


def _vectors(table: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Sums of the table's rows; bucket BUCKETS counts for nothing."""
    longer = np.concatenate([table, np.zeros((1, table.shape[1]), np.float32)])
    out = np.zeros((len(some), table.shape[1]), np.float32)
    for k in range(some.shape[1]):
        out += longer[some[:, k]]
    return out


class Classifier:
    """Weights: table (BUCKETS x DIM), filters[w] (w x DIM x FILTERS), bias per filter, output weights, calibration."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift, self.slope, self.offset = 0.0, 1.0, 0.0
        self.constant: float | None = None
        self.thresholds: dict[str | None, float] = {}

    def _pool(self, x: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Largest filter responses (documents x widths*FILTERS) and their places.  x: word vectors of all documents in a row."""
        best = np.full((len(spans), len(WIDTHS), FILTERS), -np.inf, np.float32)
        where = np.full(best.shape, -1, np.int64)
        filters, first = np.arange(FILTERS), 0
        for b0 in range(0, len(x), BLOCK):  # a bounded block of the words at a time, however long a text is
            while first < len(spans) and spans[first][1] <= b0:
                first += 1
            for k, w in enumerate(WIDTHS):
                own = x[b0 : b0 + BLOCK + w - 1]
                n = len(own) - w + 1
                if n <= 0:
                    continue
                every = (own @ self.filters[k].transpose(1, 0, 2).reshape(DIM, -1)).reshape(len(own), w, FILTERS)
                run = every[:n, 0].copy()
                for j in range(1, w):
                    run += every[j : n + j, j]
                for i in range(first, len(spans)):
                    if spans[i][0] >= b0 + n:
                        break
                    lo, hi = max(spans[i][0], b0), min(spans[i][1] - w + 1, b0 + n)
                    if hi > lo:
                        at = run[lo - b0 : hi - b0].argmax(0)
                        value = run[lo - b0 + at, filters]
                        more = value > best[i, k]
                        best[i, k] = np.where(more, value, best[i, k])
                        where[i, k] = np.where(more, lo + at, where[i, k])
        best += self.bias
        where[best <= 0] = -1
        best = np.where(where >= 0, best, 0)  # texts shorter than a filter respond with nothing
        return best.reshape(len(spans), -1), where

    def answers(self, some: np.ndarray) -> np.ndarray:
        """What each row of each filter answers to words of these feature buckets (words x the filters' rows * FILTERS), summed
        over the dimensions one after the other, so a word's answers do not depend on the words beside it."""
        vectors = _vectors(self.table, some)
        weights = np.concatenate([f.transpose(1, 0, 2).reshape(DIM, -1) for f in self.filters], axis=1)
        out = np.zeros((len(some), weights.shape[1]), np.float32)
        for d in range(DIM):
            out += vectors[:, d : d + 1] * weights[d]
        return out

    def logits(self, docs: list[np.ndarray], answers: np.ndarray) -> np.ndarray:
        """The outputs for documents, given as rows of answers; in double precision and, for a document, in a fixed order."""
        ahead, n_filters = max(WIDTHS) - 1, len(WIDTHS) * FILTERS
        none = len(answers)  # stands for a word that answers with minus infinity and closes each document, so no window crosses its end
        end = np.full(ahead, none, np.int32)
        flat = np.concatenate([x for d in docs for x in (d, end)])
        size = np.array([len(d) + ahead for d in docs])
        begin = np.cumsum(size) - size
        best = np.full((len(docs), n_filters), -np.inf, np.float32)
        for at in range(0, len(flat), BLOCK):  # a bounded block of the words at a time, however long a text is
            to = min(at + BLOCK, len(flat))
            words = np.r_[flat[at : to + ahead], end][: to - at + ahead]
            own = np.full((len(words), answers.shape[1]), -np.inf, np.float32)
            own[words < none] = answers[words[words < none]]
            first, last = np.searchsorted(begin, at, "right") - 1, np.searchsorted(begin, to)
            cuts, column = np.maximum(begin[first:last], at) - at, 0
            for k, w in enumerate(WIDTHS):
                run = own[: to - at, column : column + FILTERS]
                for j in range(1, w):
                    run = run + own[j : to - at + j, column + j * FILTERS : column + (j + 1) * FILTERS]
                column += w * FILTERS
                part = best[first:last, k * FILTERS : (k + 1) * FILTERS]
                np.maximum(part, np.maximum.reduceat(run, cuts, axis=0), out=part)
        best = np.maximum(best + self.bias.ravel(), 0).astype(np.float64)  # texts shorter than a filter respond with nothing
        z = np.full(len(docs), float(self.shift))
        for k in range(n_filters):
            z += best[:, k] * float(self.out[k])
        return z

    def chance(self, logit: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(logit), self.constant)
        return np.array([1 / (1 + math.exp(-min(30.0, max(-30.0, self.slope * z + self.offset)))) for z in logit.tolist()])

    def fit(self, texts: list[str], labels: np.ndarray, langs: list[str | None], seed: int = 7) -> Classifier:
        words = Words()
        docs = [words.rows(t) for t in texts]
        return self.fit_rows(docs, words.parts(), labels, langs, seed)

    def fit_rows(self, docs: list[np.ndarray], feats: np.ndarray, labels: np.ndarray, langs: list[str | None], seed: int = 7) -> Classifier:
        """Fit on documents given as rows of feats, the feature buckets of distinct words."""
        labels = np.asarray(labels, np.float64)
        if len(labels) < 20 or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 0.0
            return self
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(labels))
        check, train = order[: len(order) // 5], order[len(order) // 5 :]
        # log odds of each feature, by documents
        pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for i in train:
            f = np.unique(feats[np.unique(docs[i])]) if len(docs[i]) else np.array([], int)
            (pos if labels[i] else neg)[f[f < BUCKETS]] += 1
        n_pos, n_neg = labels[train].sum(), len(train) - labels[train].sum()
        odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
        odds[pos + neg < 3] = 0
        self.table[:, 0] = np.clip(odds, -3, 3) / 3
        for k in range(len(WIDTHS)):
            self.filters[k][:, 0, 0] += 1.0
        self.out[:: FILTERS] += 0.5
        self.shift = float(np.log(n_pos / n_neg))
        g_table = np.full(BUCKETS, 1e-2, np.float32)
        g_filters = [np.full(f.shape, 1e-2, np.float32) for f in self.filters]
        g_bias, g_out, g_shift = np.full(self.bias.shape, 1e-2, np.float32), np.full(self.out.shape, 1e-2, np.float32), 1e-2
        for _ in range(EPOCHS):
            rng.shuffle(train)
            sizes = np.array([len(docs[i]) for i in train])
            cuts, held, begin = [], 0, 0
            for k, size in enumerate(sizes.tolist()):  # batches of up to BATCH documents and, more or less, BLOCK words
                held += size
                if k + 1 - begin == BATCH or held >= BLOCK or k + 1 == len(sizes):
                    cuts.append((begin, k + 1))
                    begin, held = k + 1, 0
            for begin, end in cuts:
                own = train[begin:end]
                flat = np.concatenate([docs[i] for i in own])
                ends = np.cumsum([len(docs[i]) for i in own])
                spans = list(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()))
                used, back = np.unique(flat, return_inverse=True)
                x = _vectors(self.table, feats[used])[back]
                pooled, where = self._pool(x, spans)
                p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.shift, -30, 30)))
                err = (p - labels[own]).astype(np.float32) / len(own)
                d_pool = (err[:, None] * self.out).reshape(len(own), len(WIDTHS), FILTERS)
                d_out = pooled.T @ err + 1e-4 * self.out
                d_x = np.zeros_like(x)
                for k, w in enumerate(WIDTHS):
                    i, f = np.nonzero(where[:, k] >= 0)
                    at_word, d = where[i, k, f], d_pool[i, k, f]
                    d_filter = np.zeros_like(self.filters[k])
                    for j in range(w):
                        np.add.at(d_filter[j].T, f, d[:, None] * x[at_word + j])
                        np.add.at(d_x, at_word + j, d[:, None] * self.filters[k][j].T[f])
                    d_bias = np.bincount(f, d, FILTERS).astype(np.float32)
                    g_filters[k] += d_filter**2
                    self.filters[k] -= RATE * d_filter / np.sqrt(g_filters[k])
                    g_bias[k] += d_bias**2
                    self.bias[k] -= RATE * d_bias / np.sqrt(g_bias[k])
                g_out += d_out**2
                self.out -= (RATE * d_out / np.sqrt(g_out)).astype(np.float32)
                g_shift += float(err.sum()) ** 2
                self.shift -= RATE * float(err.sum()) / g_shift**0.5
                hit = np.flatnonzero(np.abs(d_x).max(1) > 0) if len(d_x) else np.array([], int)
                if len(hit):
                    bucket = feats[flat[hit]]
                    keep = bucket < BUCKETS
                    idx, g = bucket[keep], np.repeat(d_x[hit], keep.sum(1), axis=0)
                    np.add.at(g_table, idx, (g**2).mean(1))
                    np.add.at(self.table, idx, -RATE * g / np.sqrt(g_table[idx])[:, None])
        self._calibrate([docs[i] for i in check], labels[check], [langs[i] for i in check], feats)
        return self

    def _calibrate(self, docs: list[np.ndarray], labels: np.ndarray, langs: list[str | None], feats: np.ndarray) -> None:
        parts = []
        for at in range(0, len(docs), 100):  # the answers to a bounded number of words at a time
            own = docs[at : at + 100]
            used, back = np.unique(np.concatenate(own), return_inverse=True)
            cut = np.cumsum([len(d) for d in own])[:-1]
            parts.append(self.logits(np.split(back.astype(np.int32), cut), self.answers(feats[used])))
        z = np.concatenate(parts)
        a, b = 1.0, 0.0
        soft = np.where(labels > 0, (labels.sum() + 1) / (labels.sum() + 2), 1 / (len(labels) - labels.sum() + 2))
        for _ in range(500):
            g = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - soft
            a, b = max(0.05, a - 0.05 * (g * z).mean()), b - 0.2 * g.mean()
        self.slope, self.offset = a, b
        p = self.chance(z)

        def best(rows: np.ndarray) -> float:
            """The cut with the best F1, halfway in the gap it lies in."""
            s, y = p[rows], labels[rows]
            cuts = np.unique(np.r_[s, 0.3])
            mids = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else np.array([0.3])
            f1 = [2 * (y[s >= c]).sum() / max(1, (s >= c).sum() + y.sum()) for c in mids]
            return float(np.clip(mids[int(np.argmax(f1))], 0.05, 0.95)) if y.any() and not y.all() else 0.3

        every = np.arange(len(labels))
        self.thresholds = {None: best(every)}
        names = np.array([x if x is not None else "" for x in langs], object)
        for lang in sorted(set(names) - {""}):
            rows = np.flatnonzero(names == lang)
            if len(rows) >= LANG_ROWS and 0 < labels[rows].sum() < len(rows):
                self.thresholds[lang] = best(rows)

    def score(self, texts: list[str], words: Words, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of whole texts; answers grows in place with the words met."""
        docs = [words.rows(t) for t in texts]
        have = len(answers)
        for at in range(have, len(words), BLOCK):  # a bounded block of the new words at a time
            new = self.answers(words.parts(at, min(at + BLOCK, len(words))))
            if not at:
                answers = np.zeros((0, new.shape[1]), np.float32)
            if at == have:
                answers.resize((len(words), new.shape[1]), refcheck=False)  # not copied, as the two would not both fit well
            answers[at : at + BLOCK] = new
        if self.constant is not None or not docs:
            return np.full(len(texts), self.constant or 0.0), answers
        if not len(answers):  # texts without a single word
            answers = self.answers(np.full((1, PARTS), BUCKETS, np.int32))[:0]
        return self.chance(self.logits(docs, answers)), answers


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int = MAX_LABELS) -> DataFrame:
    """At most `limit` labelled rows (doc_id, text, lang, y), one per id, of those that `keep` lets through; a hash of the id
    decides which.  Of labels of one id the largest counts, of its documents the one with the smallest text."""
    fine = F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep
    chosen = labels.where(fine).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(limit)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))  # `limit` rows at most
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang")).alias("row"))
    return rows.select("doc_id", "row.text", "row.lang", "y")


def within(rows: DataFrame, size: str, most: int) -> DataFrame:
    """The rows (doc_id, ...) that fit into a total of `most`, taken by the hash of their ids; rows is stored and small."""
    left, chosen = most, []
    for doc_id, n in rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", size).collect():
        if n <= left:
            left -= n
            chosen.append((doc_id,))
    return rows.join(rows.sparkSession.createDataFrame(chosen, "doc_id long"), "doc_id", "left_semi")


def fit_numbered(rows: pd.DataFrame) -> Classifier:
    """A classifier fitted on labelled texts (doc_id, lang, y, places, parts) whose words are numbers already."""
    rows = rows.sort_values("doc_id")
    y, lang = rows["y"].to_numpy(np.int64), [x if isinstance(x, str) else None for x in rows["lang"]]
    own = [np.frombuffer(x, "<u2").reshape(-1, PARTS) for x in rows["parts"]]
    begin = np.cumsum([0, *map(len, own)])
    every = np.concatenate([np.zeros((0, PARTS), "<u2"), *own])
    places = [np.frombuffer(x, "<i4") for x in rows["places"]]
    del own, rows
    _, first, back = np.unique(every.view(f"V{2 * PARTS}").ravel(), return_index=True, return_inverse=True)
    feats, back = every[first].astype(np.int32), back.astype(np.int32)
    words = [back[a + x] for a, x in zip(begin, places)]
    del every, first, back, places
    release_memory()
    return Classifier().fit_rows(words, feats, y, lang)


def train(docs: DataFrame, labels: DataFrame, keep: Column, limit: int = MAX_LABELS, most: int = MAX_WORDS) -> Classifier:
    """A classifier fitted on the labelled rows of `labels` that `keep` lets through.

    One task fits it, on `limit` texts of `most` words in all at most; the driver gets the weights only.
    """

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each text as places in a list of feature buckets of its own."""
        for b in batches:
            out = []
            for text in b["text"]:
                words = Words()
                rows = words.rows(text)
                out.append((len(rows), rows.tobytes(), words.parts().astype("<u2").tobytes()))
            yield b.drop(columns="text").assign(n=[x[0] for x in out], places=[x[1] for x in out], parts=[x[2] for x in out])

    rows = labelled(docs, labels, "toxic", keep, limit).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "y")
    rows = write_table(small_batches(rows).mapInPandas(number, "doc_id long, lang string, y int, n long, places binary, parts binary"), "labelled")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pickle.dumps(fit_numbered(pd.concat(list(batches))))
        release_memory()
        yield pd.DataFrame({"model": [model]})

    fitted = write_table(within(rows, "n", most).repartition(1).mapInPandas(fit, "model binary"), "model").first()
    return pickle.loads(fitted["model"]) if fitted else fit_numbered(rows.limit(0).toPandas())  # without any labelled text


def scorer(model: Classifier) -> Callable[[pd.Series], pd.Series]:
    """A pandas UDF that scores whole texts."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, answers = Words(), np.zeros((0, 0), np.float32)
        for b in batches:
            out = []
            for at in range(0, len(b), TEXTS):
                if len(words) > REMEMBER:
                    words, answers = Words(), np.zeros((0, 0), np.float32)
                s, answers = model.score([x or "" for x in b.iloc[at : at + TEXTS]], words, answers)
                out.append(s)
            yield pd.Series(np.concatenate(out) if out else np.array([], float))
            release_memory()
        del words, answers
        release_memory()

    return score


def threshold(df: DataFrame, model: Classifier) -> Column:
    """The threshold of each row's language."""
    cut = F.lit(model.thresholds.get(None, 0.3))
    if "lang" in df.columns:
        for name, value in model.thresholds.items():
            if name is not None:
                cut = F.when(F.col("lang") == name, value).otherwise(cut)
    return cut


def score_toxicity(df: DataFrame, model: Classifier) -> DataFrame:
    """df with toxicity (0 to 1) and toxic (whether it reaches the threshold of the row's language), in place of columns of these names."""
    cut = threshold(df, model)
    out = small_batches(df).withColumn("toxicity", scorer(model)(F.coalesce(F.col("text"), F.lit(""))))
    return out.withColumn("toxic", F.col("toxicity") >= cut)


def drop_toxic(df: DataFrame, model: Classifier) -> DataFrame:
    """The rows below their language's threshold, columns unchanged."""
    return small_batches(df).where(scorer(model)(F.coalesce(F.col("text"), F.lit(""))) < threshold(df, model))

"""License scan over a positional index of rare licence words.

Templates (short licence phrases and notices) are indexed by word: each word posts the templates and places where it
stands.  One pass over all documents counts in how many of them each template word occurs; a scan then takes, of each
file, the licence words of highest inverse document frequency, intersects their postings by relative position (a place
in the file less the place in the template is the same for all words of one copy), and keeps an alignment only where the
template's mandatory key phrases stand in it.

Base phrases must match word by word; every place counts.  Notices may differ in some words: an alignment needs its key
phrases and a share of the template's words (weighed by inverse document frequency) near their places.

Defined results: null and empty texts have no words, no labels and score 0; rows that repeat an id are scanned each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices as public licences word them, with the key phrases that must stand in a copy.
NOTICES = {
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license version 2 0"]),
    "apache-2.0-notice": ("you may not use this file except in compliance with the license you may obtain a copy of the license at", ["in compliance with the license"]),
    "gpl-2.0": ("licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    "gpl-3.0": ("licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    "gpl-notice": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["free software", "gnu general public license"]),
    "lgpl": ("under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    "agpl": ("under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    "mit-release": ("released under the mit license", ["mit license"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights cc0", ["waived all copyright and related"]),
    "cc-by-4.0": ("licensed under cc by 4 0", ["cc by 4 0"]),
    "cc-by-nc": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "cc-by-sa": ("licensed under cc by sa 4 0", ["cc by sa"]),
    "cc-by-nd": ("licensed under cc by nd 4 0", ["cc by nd"]),
    "creative-commons": ("this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
}
#: Licence words of a file and template that are looked up, and the share of a notice's weight that a copy must show.
LOOKUPS, COVER = 6, 0.6

_KEEP = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z: runs of letters, digits and characters beyond ASCII."""
    return text.encode().lower().translate(_KEEP).split() if text else []


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    base: bool


class Index:
    """Postings of the template words, with their inverse document frequencies."""

    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, tuple[str, list[str]]] = NOTICES):
        cut = lambda x: tuple(x.encode().split())
        self.templates = [Template(label, cut(phrase), (cut(phrase),), True) for phrase, label in base.items()]
        self.templates += [Template(label, cut(text), tuple(map(cut, keys)), False) for label, (text, keys) in notices.items()]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, template in enumerate(self.templates):
            for place, word in enumerate(template.words):
                self.postings[word].append((t, place))
        self.words = frozenset(self.postings)
        self.needs = [frozenset(w for key in t.keys for w in key) for t in self.templates]
        self.idf = dict.fromkeys(self.words, 1.0)

    def weigh(self, n_docs: int, counts: dict[bytes, int]) -> Index:
        self.idf = {w: math.log((n_docs + 1) / (counts.get(w, 0) + 0.5)) + 1e-6 for w in self.words}
        return self

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, str, float]]]:
        """Base places (start, label) and notices (start, label, share of weight found)."""
        present = self.words.intersection(words)
        viable = [t for t, need in enumerate(self.needs) if need <= present]
        if not viable:
            return [], []
        look: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        rare = {}
        for t in viable:
            own = sorted(present.intersection(self.templates[t].words), key=lambda w: (-self.idf[w], w))
            for w in own[: 1 if self.templates[t].base else LOOKUPS]:  # a base phrase's rarest word leads to all its places
                look[w] += [(x, place) for x, place in self.postings[w] if x == t]
            rare[t] = min(LOOKUPS, len(own))
        votes: dict[int, Counter] = defaultdict(Counter)
        places: dict[bytes, list[int]] = defaultdict(list)
        needed = frozenset(look) | {key[0] for t in viable for key in self.templates[t].keys}
        for at, w in enumerate(words):
            if w in needed:
                places[w].append(at)
        for w, posts in look.items():
            for at in places[w]:
                for t, place in posts:
                    votes[t][at - place] += 1
        base, notices = [], []
        for t, ballot in votes.items():
            template = self.templates[t]
            size = len(template.words)
            if template.base:
                base += [(s, template.label) for s in sorted(ballot) if s >= 0 and tuple(words[s : s + size]) == template.words]
                continue
            slack, taken = 2 + size // 8, -1
            starts = sorted(ballot)
            for s in starts:
                if s <= taken or sum(ballot[x] for x in starts[bisect_left(starts, s) : bisect_left(starts, s + slack + 1)]) * 2 < rare[t]:
                    continue
                lo, hi = max(0, s - slack), s + size + 2 * slack
                if not all(any(lo <= at and at + len(key) <= hi and tuple(words[at : at + len(key)]) == key for at in places[key[0]][bisect_left(places[key[0]], lo) : bisect_left(places[key[0]], hi)]) for key in template.keys):
                    continue
                have, want = Counter(words[lo:hi]), Counter(template.words)
                share = sum(min(n, have[w]) * self.idf[w] for w, n in want.items()) / sum(n * self.idf[w] for w, n in want.items())
                if share >= COVER:
                    notices.append((max(0, s), template.label, min(1.0, share)))
                    taken = s + size
        return sorted(base), sorted(notices)


def build_index(df: DataFrame, text_col: str = "text", base: dict[str, str] = BASE, notices: dict[str, tuple[str, list[str]]] = NOTICES) -> Index:
    """The index weighed by document frequencies over all rows of df; one number per template word reaches the driver."""
    index = Index(base, notices)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = Counter(), 0
        for b in batches:
            for text in b["text"]:
                total.update(index.words.intersection(words_of(text)))
            n += len(b)
        yield pd.DataFrame({"word": ["", *(w.decode() for w in total)], "n": [n, *total.values()]})

    rows = small_batches(df).select(F.col(text_col).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {w.encode(): n for w, n in rows}
    return index.weigh(counts.pop(b"", 0), counts)


def scan(df: DataFrame, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, base (array of start, label), notices (array of start, label, share)."""
    index = index or build_index(df, text_col)

    @F.pandas_udf("struct<n_words:long,base:array<struct<start:long,label:string>>,notices:array<struct<start:long,label:string,share:double>>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            words = words_of(text)
            base, notices = index.scan(words)
            out.append((len(words), [{"start": s, "label": x} for s, x in base], [{"start": s, "label": x, "share": p} for s, x, p in notices]))
        return pd.DataFrame(out, columns=["n_words", "base", "notices"])

    return small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), run(F.coalesce(F.col(text_col), F.lit(""))).alias("x")).select("doc_id", "x.*")


def digest(scanned: DataFrame) -> DataFrame:
    """The scan as flat columns: n_base, first_word, last_word, base_labels, labels, score."""
    starts, base = F.transform("base", lambda x: x["start"]), F.transform("base", lambda x: x["label"])
    labels = F.concat(base, F.transform("notices", lambda x: x["label"]))
    join = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("notices", lambda x: x["share"])), F.lit(0.0)))
    return scanned.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), join(base).alias("base_labels"), join(labels).alias("labels"), score.alias("score"))

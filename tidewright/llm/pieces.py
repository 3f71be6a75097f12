"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

Every way to write a text in the model's pieces is a path through a lattice; a path's weight is the product of its
pieces' weights, by Zipf's law one over the piece's rank in the vocabulary (the rank is what the model file's BPE
scores state).  Forward filtering sums the weights of all paths that reach each place, backward sampling then draws one
path from the exact distribution.  No piece spans a space that follows another character, so the lattice falls apart at
those places, is built once for each distinct word, and all words of a batch are sampled together.  The random numbers
are hashes of the row's key, the word's place and the step: reruns, other batch sizes and lost executors give the same
segmentation.

Characters without a piece are written as byte pieces, also the character that the model itself uses to mark spaces, so
decoding returns each text exactly.

Defined results: null and empty texts have no pieces; rows that repeat a key get equal segmentations; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, small_batches

#: Arcs of lattices remembered by a worker (12 bytes each); when it is full, the words used most often stay.
REMEMBER = 5_000_000
#: Words sampled together, and letters of new words whose lattices are built together.
BLOCK, LETTERS = 60_000, 1 << 15
#: Offset of the rank in Zipf's law, and the power of the weights: larger ones sample closer to the best path.
OFFSET, POWER = 2.7, 1.0

_MARK = "▁"
_SPACES = re.compile(r" ( *[^ ]+| *$)")
_MODELS: dict[str, Pieces] = {}
_GOLD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def seeds(keys: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Of each word, what its numbers are drawn from."""
    return keys + _GOLD * (word.astype(np.uint64) * np.uint64(1 << 20))


def uniform(seed: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) from the words' seeds and the step (the SplitMix64 finaliser)."""
    x = seed + np.array([step + 1], np.uint64) * _GOLD
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Numbers(dict):
    """Numbers of words by one look-up each: a word that is met for the first time gets the next number and is listed as new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


def parts(words: list[str], letters: int) -> Iterator[list[str]]:
    """The words in runs of at most so many letters, or of one word."""
    begin = held = 0
    for at, word in enumerate(words):
        held += len(word)
        if held > letters and at > begin:
            yield words[begin:at]
            begin, held = at, len(word)
    if words:
        yield words[begin:]


class Store:
    """An array that grows at its end.  Its room doubles, so what it holds is not copied for every block of words."""

    def __init__(self, kind: type):
        self.all, self.n = np.empty(1 << 10, kind), 0

    def add(self, more: np.ndarray) -> None:
        if (upto := self.n + len(more)) > len(self.all):
            self.all, old = np.empty(max(upto, 2 * len(self.all)), self.all.dtype), self.all
            self.all[: self.n] = old[: self.n]
        self.all[self.n : upto] = more
        self.n = upto

    def keep(self, which: np.ndarray) -> None:
        """Only these stay, in the room there is."""
        kept = self.now[which]
        self.n = len(kept)
        self.now = kept

    @property
    def now(self) -> np.ndarray:
        return self.all[: self.n]

    @now.setter
    def now(self, values: np.ndarray) -> None:
        self.all[: self.n] = values


class Pieces:
    """The vocabulary of one model, its lattices, sampler and decoder."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size, self.ids, self.byte, self.bytes = n, {}, {}, [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte[value], self.bytes[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = piece.replace(_MARK, " ")
                self.ids[text], self.bytes[i] = i, text.encode()
        self.bytes = np.array(self.bytes, object)
        first = min(self.ids.values(), default=0)
        self.cost = np.full(n, np.inf)
        for i in self.ids.values():
            self.cost[i] = POWER * math.log(i - first + 1 + OFFSET)
        self.byte_cost = POWER * math.log(n + OFFSET)
        self.longest = max(map(len, self.ids), default=1)
        self._trie()
        self._start_anew()

    def _trie(self) -> None:
        """The pieces' prefixes as states; (state, character) to next state in an open-addressed table."""
        letters = sorted({c for piece in self.ids for c in piece})
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        states, self.state_piece, keys, values = {"": 0}, [-1], [], []
        for piece, i in self.ids.items():
            for k in range(1, len(piece) + 1):
                if piece[:k] not in states:
                    states[piece[:k]] = len(self.state_piece)
                    self.state_piece.append(-1)
                    keys.append(states[piece[: k - 1]] << 20 | int(self.letter[ord(piece[k - 1])]))
                    values.append(states[piece[:k]])
            self.state_piece[states[piece]] = i
        self.state_piece = np.array(self.state_piece)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.table_key, self.table_value = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        keys, values = np.array(keys, np.int64), np.array(values, np.int64)
        self.root = np.full(len(letters) + 1, -1)  # by letter: the state after it alone
        self.root[keys[keys < 1 << 20]] = values[keys < 1 << 20]
        at = self._slot(keys)
        while len(keys):
            free = self.table_key[at] < 0
            self.table_key[at[free]], self.table_value[at[free]] = keys[free], values[free]
            left = self.table_key[at] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * _GOLD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The next states, -1 where no piece goes on like that."""
        keys = states << 20 | letters
        at = self._slot(keys)
        have = self.table_key[at]
        out = np.where(have == keys, self.table_value[at], -1)
        todo = np.flatnonzero((have != keys) & (have >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            have = self.table_key[at[todo]]
            hit = have == keys[todo]
            out[todo[hit]] = self.table_value[at[todo[hit]]]
            todo = todo[~hit & (have >= 0)]
        return out

    def _start_anew(self) -> None:
        self.known = Numbers()
        self.start, self.entry, self.uses = Store(np.int64), Store(np.int64), Store(np.int64)  # of each word: its first arc, the first arc of its end
        # of each arc: its summed chance, its code, and the first arc of the place it comes from (-1: the word's beginning)
        self.chance, self.code, self.before = Store(np.float32), Store(np.int32), Store(np.int32)

    def _learn(self, words: list[str]) -> None:
        """Lattices of new words.  A place stands for a prefix of a word; its arcs are the pieces that end there, with summed
        chances.  A code below the vocabulary's size is a piece; one above it is a character to be written as bytes."""
        length = np.array([len(w) for w in words])
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        n = len(chars)
        base = np.cumsum(length) - length
        place = np.arange(n) - np.repeat(base, length)
        left = np.repeat(length, length) - place
        letters = self.letter[chars].astype(np.int64)
        found: list[tuple[np.ndarray, int, np.ndarray]] = []  # starts, length, codes
        at, state = np.arange(n), np.zeros(n, np.int64)
        for size in range(1, self.longest + 1):
            fits = left[at] >= size
            at, state = at[fits], state[fits]
            state = self._step(state, letters[at + size - 1]) if size > 1 else self.root[letters]
            at, state = at[state >= 0], state[state >= 0]
            if not len(at):
                break
            piece = self.state_piece[state]
            found.append((at[piece >= 0], size, piece[piece >= 0]))
        single = np.zeros(n, bool)
        if found and found[0][1] == 1:
            single[found[0][0]] = True
        raw = np.flatnonzero(~single)
        if len(raw):
            one_byte = np.array([self.byte.get(b, 0) for b in range(128)])
            found.append((raw, 1, np.where(chars[raw] < 128, one_byte[np.minimum(chars[raw], 127)], self.size + chars[raw])))
        ends = [s + size - 1 for s, size, _ in found]
        counts = np.bincount(np.concatenate(ends), minlength=n) if ends else np.zeros(n, np.int64)
        # arcs by how far into its word a place is, so that each step below is one slice
        order = np.argsort(place.astype(np.uint16 if length.max() <= 1 << 16 else np.int32), kind="stable")
        by_depth = np.cumsum(counts[order]) - counts[order]
        first_deep = np.empty(n, np.int64)
        first_deep[order] = by_depth
        total_arcs = int(counts.sum())
        start, code = np.empty(total_arcs, np.int64), np.empty(total_arcs, np.int64)
        filled = np.zeros(n, np.int64)
        for (s, size, c), e in zip(found, ends):
            to = first_deep[e] + filled[e]
            filled[e] += 1
            start[to], code[to] = np.where(place[s] > 0, s - 1, n), c
        plain = code < self.size
        cost = np.empty(total_arcs)
        is_byte = np.zeros(self.size, bool)
        is_byte[list(self.byte.values())] = True
        cost[plain] = np.where(is_byte[code[plain]], self.byte_cost, self.cost[code[plain]])
        wide = code[~plain] - self.size
        cost[~plain] = self.byte_cost * (2 + (wide > 0x7FF) + (wide > 0xFFFF))
        total, chance = np.zeros(n + 1), np.empty(total_arcs)
        depth_nodes = np.cumsum(np.bincount(place))
        a0 = n0 = 0
        for n1 in depth_nodes.tolist():
            nodes = order[n0:n1]
            many = counts[nodes]
            a1 = a0 + int(many.sum())
            begin = np.cumsum(many) - many
            x = total[start[a0:a1]] - cost[a0:a1]
            top = np.maximum.reduceat(x, begin)
            e = np.exp(x - np.repeat(top, many))
            run = np.cumsum(e)
            whole = np.add.reduceat(e, begin)
            total[nodes] = top + np.log(whole)
            chance[a0:a1] = (run - np.repeat(run[begin] - e[begin], many)) / np.repeat(whole, many)
            chance[a0 + begin + many - 1] = 2.0  # whatever the rounding, the last arc is taken
            a0, n0 = a1, n1
        # word by word for the store
        first = np.cumsum(counts) - counts + self.code.n
        back = np.repeat(first_deep - first, counts) + np.arange(self.code.n, self.code.n + total_arcs)
        self.start.add(first[base])
        self.entry.add(first[base + length - 1])
        self.uses.add(np.zeros(len(words), np.int64))
        self.chance.add(chance[back])
        self.code.add(code[back])
        self.before.add(np.r_[first, -1][start[back]])

    def _words(self, words: list[str]) -> np.ndarray:
        """Numbers of the words, learning new ones."""
        if self.code.n > REMEMBER:
            self._forget()
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            for part in parts(self.known.new, LETTERS):  # a lattice in the making takes a multiple of what is remembered of it
                self._learn([" " + w for w in part])
            self.known.new.clear()
        self.uses.now += np.bincount(which, minlength=self.uses.n)
        return which

    def _forget(self) -> None:
        """Room for new words: those used more than once stay, the most used ones first, up to half of the memory."""
        words, uses = list(self.known), self.uses.now
        many = np.diff(self.start.now, append=self.code.n)
        order = np.argsort(-uses, kind="stable")
        keep = np.zeros(len(words), bool)
        keep[order[(uses[order] > 1) & (np.cumsum(many[order]) <= REMEMBER // 2)]] = True
        moved = self.start.now - (np.cumsum(many * keep) - many * keep)
        self.known = Numbers()
        self.known.update(zip(compress(words, keep.tolist()), range(len(words))))
        del words
        self.start.now -= moved
        self.entry.now -= moved
        self.uses.now //= 2
        for of_word in (self.start, self.entry, self.uses):
            of_word.keep(keep)
        arcs = np.repeat(keep, many)
        for of_arc in (self.chance, self.code, self.before):  # one after the other and in place: the memory is full
            of_arc.keep(arcs)
        self.before.now -= np.repeat(moved[keep].astype(np.int32), many[keep])
        self.before.now = np.maximum(self.before.now, -1)

    def split(self, text: str) -> list[str]:
        """The words of a text, each without the one space that all begin with (the first one's is put before the text)."""
        if not text:
            return []
        return _SPACES.findall(" " + text) if "  " in text or text[0] == " " or text[-1] == " " else text.split(" ")

    def sample(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Ids of each text, sampled with the numbers of its key."""
        words: list[str] = []
        parts: list[tuple[int, int, int]] = []  # of each run of words of one text: the text, the first word's place, how many
        out: list[list[np.ndarray]] = [[] for _ in texts]

        def flush() -> None:
            if words:
                row, first, many = np.array(parts).T
                end = np.cumsum(many)
                place = np.arange(len(words)) + np.repeat(first - end + many, many)
                ids, ends = self._block(words, seeds(np.repeat(keys[row], many), place))
                for k, a, b in zip(row.tolist(), ends[end - many].tolist(), ends[end].tolist()):
                    out[k].append(ids[a:b])
                words.clear(), parts.clear()

        for i, text in enumerate(texts):
            own = self.split(text)
            for at in range(0, len(own), BLOCK):
                part = own[at : at + BLOCK]
                words += part
                parts.append((i, at, len(part)))
                if len(words) >= BLOCK:
                    flush()
        flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.array([], np.int32) for x in out]

    def _block(self, words: list[str], seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each word's ids begin."""
        which, live = self._words(words), np.arange(len(words))
        arc, chance, steps, n_steps = self.entry.all[which], self.chance.all, [], np.zeros(len(words), np.int64)
        while len(live):
            u = uniform(seed, len(steps)).astype(np.float32)
            on = np.flatnonzero(chance[arc] <= u)
            while len(on):
                arc[on] += 1
                on = on[chance[arc[on]] <= u[on]]
            steps.append((live, self.code.all[arc]))
            n_steps[live] += 1
            arc = self.before.all[arc].astype(np.int64)
            on = np.flatnonzero(arc >= 0)
            live, arc, seed = live[on], arc[on], seed[on]
        ends = np.r_[0, np.cumsum(n_steps)]
        flat = np.empty(ends[-1], np.int32)
        for k, (live, code) in enumerate(steps):  # sampled from the end: the k-th step is the k-th piece from the back
            flat[ends[live + 1] - 1 - k] = code
        wide = np.flatnonzero(flat >= self.size)
        if len(wide):
            raw = [chr(c - self.size).encode() for c in flat[wide].tolist()]
            many = np.ones(len(flat), np.int64)
            many[wide] = [len(x) for x in raw]
            begin = np.r_[0, np.cumsum(many)]
            flat = np.repeat(flat, many)
            for k, x in zip(wide.tolist(), raw):
                flat[begin[k] : begin[k + 1]] = [self.byte[b] for b in x]
            ends = begin[ends]
        return flat, ends

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.bytes[np.asarray(ids, np.intp)].tolist()).decode()[1:]


def pieces(path: str) -> Pieces:
    """One vocabulary per Python worker and model file."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """One row per document: doc_id, ids, n_tokens, ids_crc32 (little-endian 32-bit), lossless (decoding gave the text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        m = pieces(model)
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                texts = part["text"].tolist()
                keys = np.array([xxhash.xxh64_intdigest(x, seed) for x in part["key"]], np.uint64)
                ids = m.sample(texts, keys)
                yield pd.DataFrame({"doc_id": part["id"].array, "ids": ids, "n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], "lossless": [m.decode(x) == t for x, t in zip(ids, texts)]})
            release_memory()  # what a batch leaves free in pieces would add to the lattices
        m._start_anew()  # the worker stays, and later stages share the executor's memory with it
        release_memory()

    rows = small_batches(df).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, lossless boolean")


def decode(df: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """df with the column decoded: the exact texts that the ids were made from."""

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        m = pieces(model)
        return pd.Series([m.decode(np.asarray(x)) if x is not None else None for x in ids])

    return df.withColumn("decoded", run(F.col(ids_col)))

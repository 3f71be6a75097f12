"""Token-ID output in the seekable zstandard format, and its readers.

A shard file is a run of independent zstandard frames, one per document (a very long document takes several), then a
skippable frame with the documents' ids and lengths, then the seek table of the public seekable format: a skippable
frame with each frame's compressed size, decompressed size and checksum (low 32 bits of the XXH64 of the content).  A
reader fetches the two tables, seeks to the frames of the documents it wants, decompresses only those and verifies their
checksums.  Any zstandard tool can decompress the whole file, which yields the ids as little-endian unsigned 32-bit
integers, each document closed by the end id.

Documents are range-partitioned by id and sorted, one shard per partition; there are as many as `SHARD_BYTES` of text each
ask for, and no fewer than the session's shuffle partitions.  The manifest tells each shard's ids, so a reader of a few
documents opens only shards that can hold them.  A task writes under a name of its own, and
only files named by a finished task's row enter the manifest, so retried or speculative tasks do no harm.

Defined results: null and empty texts are one end id; rows that repeat an id are all written, by a hash of the text and then the
text, and may fill several shards; null ids come first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, release_memory, small_batches, write_table
from .pieces import Store

DOCS_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Ids in one frame at most.
FRAME_IDS = 1 << 24
#: Pieces of text remembered by an encoder, of `PIECE_IDS` ids on average at most; half of them, those met last, stay when it is full.
REMEMBER, PIECE_IDS = 700_000, 16
#: New pieces that the library gets at once, which holds many times their text.
AT_ONCE = 10_000
END_ID = 0
#: Bytes of text in a shard, and bytes of ids that a reader holds.
SHARD_BYTES, READ_BYTES = 256 << 20, 8 << 20
# Names that Spark's readers give to schemes of object stores.
SCHEMES = {"s3a": "s3", "s3n": "s3"}

_ENCODERS: dict[str, Encoder] = {}

# Classes of bytes: what is known of the character that a byte belongs to.
_OTHER, _LETTER, _DIGIT, _MARK, _SPACE, _BREAK, _QUOTE, _WIDE = range(8)  # _WIDE: no white space, else unknown


def _class_tables() -> tuple[bytes, bytes]:
    """The class of each byte, and for two neighbours (8 * class + class): 1 a piece ends between them, 2 one ends before both."""
    kind = np.full(256, _OTHER, np.uint8)
    for c in range(33, 127):
        kind[c] = _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _QUOTE if chr(c) == "'" else _MARK
    kind[32], kind[9:14], kind[128:] = _SPACE, _BREAK, _WIDE
    pair = np.zeros((8, 8), np.uint8)
    dark = [_LETTER, _DIGIT, _MARK, _QUOTE, _WIDE]
    for x in dark:
        pair[x, [_SPACE, _BREAK]] = 1
        pair[_SPACE, x], pair[_BREAK, x] = 2, 3
    for x in (_LETTER, _DIGIT):
        pair[x, [_MARK, _QUOTE]] = 1
        pair[_MARK, x] = 1
    pair[_LETTER, _DIGIT] = pair[_DIGIT, _LETTER] = pair[_QUOTE, _DIGIT] = 1  # a letter after ' may belong to it
    return kind.tobytes(), pair.tobytes().ljust(256, b"\0")


_KIND, _PAIR = _class_tables()


def _pieces(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces of the texts (UTF-8, one after another, none empty) begin: a place is given only if the pre-tokenizer surely
    parts the text there.  That is before white space that ends a word; before the last of several white spaces if a word follows,
    and after it too if it is no space; between letters, digits and punctuation, but for what may be an English contraction."""
    kind = np.frombuffer(bytearray(data.tobytes().translate(_KIND)), np.uint8)
    wide = np.flatnonzero(data >= 0xC2)  # first bytes of longer characters
    if len(wide):
        lead, second = data[wide], data[wide + 1]
        letter = ((lead >= 0xC3) & (lead <= 0xC8) | (lead == 0xD0) | (lead == 0xD1)) & ~((lead == 0xC3) & ((second == 0x97) | (second == 0xB7)))
        at = wide[letter]  # Latin and Cyrillic letters, all of two bytes
        kind[at] = kind[at + 1] = _LETTER
        blank = wide[(lead == 0xC2) & ((second == 0x85) | (second == 0xA0))]
        kind[blank] = kind[blank + 1] = _OTHER
        at = wide[(lead == 0xE1) & (second == 0x9A) | (lead == 0xE2) & ((second == 0x80) | (second == 0x81)) | (lead == 0xE3) & (second == 0x80)]
        for k in range(3):  # some of these are white space
            kind[at + k] = _OTHER
    pair = kind[:-1] * 8
    pair += kind[1:]
    pair[starts[1:] - 1] = 0
    ends = np.frombuffer(pair.tobytes().translate(_PAIR), np.uint8)
    begins = np.zeros(len(data), np.uint8)
    begins[1:] = ends & 1
    begins[:-1] |= ends >> 1
    begins[starts] = 1
    return np.flatnonzero(begins)


class Encoder:
    """Byte-level BPE ids of whole texts by the tokenizers library.

    Texts are cut where the library's byte-level pre-tokenizer surely cuts them, and a piece already seen is not encoded again.  New
    pieces are encoded as one text; the ids' byte lengths tell where each piece ends.  A text that holds the string of an added
    token (an end mark, say) goes to the library as a whole, which reads that string as the token; so do all texts of a
    vocabulary with another pre-tokenizer or with a normalizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        settings = json.loads(self.tokenizer.to_str())
        first = settings["pre_tokenizer"] or {}
        self.cuts = settings["normalizer"] is None and first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # byte-level: a character of a token's string stands for one byte
            self.length[i] = len(token)
        self.batch = 0
        self._start_anew()

    def _start_anew(self) -> None:
        self.known: dict[str, int] = {}  # the number of a piece; its ids are ids[begin : begin + many], it was last met in batch `met`
        self.ids, self.begin, self.many, self.met = Store(np.uint32), Store(np.int64), Store(np.int32), Store(np.int32)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[str], ids: np.ndarray, many: np.ndarray, met: np.ndarray | None = None) -> None:
        """Number pieces and keep their ids."""
        self.known.update(zip(words, range(self.many.n, self.many.n + len(words))))
        self.begin.add(self.ids.n + np.cumsum(many, dtype=np.int64) - many)
        self.many.add(many)
        self.met.add(np.full(len(words), self.batch) if met is None else met)
        self.ids.add(ids)

    def _joined(self, words: list[str], mark: str) -> None:
        """Learn pieces that neither begin nor end with white space, except for a space before them (mark "") or none (mark "\n",
        which is a piece of its own)."""
        for k in range(0, len(words), AT_ONCE):
            some = words[k : k + AT_ONCE]
            (ids,) = self._raw([mark + mark.join(some)])
            ends = np.cumsum(self.length[ids])
            want = np.cumsum([len(w if w.isascii() else w.encode()) + len(mark) for w in some])
            to = np.searchsorted(ends, want) + 1
            if ends[-1] != want[-1] or (ends[to - 1] != want).any():
                raise ValueError("the vocabulary is not byte-level")
            many = np.diff(to, prepend=0)
            if mark:
                marks = to - many
                if (self.length[ids[marks]] != 1).any():
                    raise ValueError("the vocabulary is not byte-level")
                ids, many = np.delete(ids, marks), many - 1
            self._add(some, ids, many)

    def _learn(self, words: list[str]) -> None:
        spaced, bare, odd = [], [], []
        for w in words:
            if w[-1].isspace() or w[0].isspace() and (w[0] != " " or w[1].isspace()):
                odd.append(w)
            elif w[0] == " ":
                spaced.append(w)
            else:
                bare.append(w)
        self._joined(spaced, "")
        self._joined(bare, "\n")
        if odd:
            made = self._raw(odd)
            self._add(odd, np.concatenate(made), np.array([len(x) for x in made]))

    def _forget(self) -> None:
        """Keep the pieces met last, half of what may be remembered, and none that is long."""
        begin, many, met = self.begin.now, self.many.now, self.met.now
        half = REMEMBER // 2
        keep = (many <= 64) & (met > (np.partition(met, -half - 1)[-half - 1] if len(met) > half else -1))
        words = [w for w, stays in zip(self.known, keep.tolist()) if stays]  # they stand in the order of their numbers
        ids = self.ids.now[_spans(begin[keep], many[keep])]
        self._start_anew()
        self._add(words, ids, many[keep], met[keep])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text.  Texts are cut and their pieces numbered in numpy and Arrow; only distinct pieces are looked up."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string())
        whole = np.full(len(texts), not self.cuts)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(whole).tolist()
        out = [b""] * len(texts)
        for i, ids in zip(at, self._raw([texts[i].as_py() for i in at])):
            out[i] = ids.tobytes()
        plain = np.flatnonzero(~whole & (pc.binary_length(texts).to_numpy() > 0))
        if not len(plain):
            return out
        texts = texts.take(pa.array(plain))
        starts, data = np.frombuffer(texts.buffers()[1], np.int64)[: len(plain) + 1], texts.buffers()[2]
        pieces = _pieces(np.frombuffer(data, np.uint8)[: starts[-1]], starts[:-1])
        coded = pa.LargeStringArray.from_buffers(len(pieces), pa.py_buffer(np.append(pieces, starts[-1])), data).dictionary_encode()
        numbers = self._find(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        many = self.many.now[numbers].astype(np.int64)
        ids = self.ids.now[_spans(self.begin.now[numbers], many)].astype("<u4", copy=False)
        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(many), [None, pa.py_buffer(4 * np.r_[0, np.cumsum(many)]), pa.py_buffer(ids)]).take(coded.indices)
        cut = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(pieces, starts)].tolist()
        raw = memoryview(ids.buffers()[2])
        for i, x, y in zip(plain.tolist(), cut, cut[1:]):
            out[i] = raw[x:y].tobytes()
        if len(self.known) > REMEMBER or self.ids.n > PIECE_IDS * REMEMBER:
            self._forget()
        return out

    def _find(self, words: list[str]) -> np.ndarray:
        """The numbers of distinct pieces."""
        self.batch += 1
        found = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            words = [words[k] for k in new.tolist()]
            self._learn(words)
            found[new] = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.met.now[found] = self.batch
        return found


def _spans(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begin, begin + 1 and so on, many of each, one after another."""
    stop = np.cumsum(many)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - stop + many, many)


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _open(uri: str, mode: str):
    from pyarrow import fs

    scheme, mark, rest = uri.partition("://")
    try:
        system, path = fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + mark + rest)
    except (pa.ArrowInvalid, OSError) as e:
        raise ValueError(f"token files need a folder that pyarrow can open, not {uri}: {e}") from e
    if mode == "w":
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path, compression=None)
    return system.open_input_file(path)


def write_shard(out, docs: Iterable[tuple[int | None, bytes]], level: int = 3) -> tuple[int, int]:
    """Write one shard; docs: (id, ids as bytes).  Returns documents and ids written."""
    import xxhash
    import zstandard

    press = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    frames, index, total = [], [], 0
    for doc_id, ids in docs:
        parts = [ids[i : i + 4 * FRAME_IDS] for i in range(0, len(ids), 4 * FRAME_IDS)]
        for part in parts:
            packed = press.compress(part)
            out.write(packed)
            frames.append((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        index.append((doc_id is not None, doc_id or 0, len(ids) // 4, len(parts)))
        total += len(ids) // 4
    body = b"".join(struct.pack("<?qqI", *x) for x in index)
    out.write(struct.pack("<II", DOCS_MAGIC, len(body)) + body)
    table = b"".join(struct.pack("<III", *x) for x in frames)
    out.write(struct.pack("<II", SEEK_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(frames), 0x80, FOOTER_MAGIC))
    return len(index), total


class Shard:
    """Random access to one shard file (an open seekable file)."""

    def __init__(self, file):
        import zstandard

        self.file, self.unpress = file, zstandard.ZstdDecompressor()
        file.seek(0, 2)
        end = file.tell()
        file.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != FOOTER_MAGIC:
            raise ValueError("no seek table at the end of the file")
        file.seek(end - 9 - 12 * n)
        self.frames = np.frombuffer(file.read(12 * n), "<u4").reshape(-1, 3)
        self.offsets = np.r_[0, np.cumsum(self.frames[:, 0], dtype=np.int64)]
        file.seek(int(self.offsets[-1]))
        magic, length = struct.unpack("<II", file.read(8))
        if magic != DOCS_MAGIC:
            raise ValueError("no document table before the seek table")
        self.docs = np.frombuffer(file.read(length), np.dtype([("known", "?"), ("id", "<i8"), ("n", "<i8"), ("frames", "<u4")]))
        self.first = np.r_[0, np.cumsum(self.docs["frames"], dtype=np.int64)]

    def read(self, place: int) -> bytes:
        """The ids of the document at that place, its frames' checksums verified."""
        import xxhash

        out = []
        for k in range(self.first[place], self.first[place + 1]):
            self.file.seek(int(self.offsets[k]))
            part = self.unpress.decompress(self.file.read(int(self.frames[k, 0])))
            if xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"checksum of frame {k} differs")
            out.append(part)
        return b"".join(out)


def write_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write all documents in ascending id order; returns the manifest: shard, path, n_docs, n_tokens, low and high (smallest and
    largest id, null without), start (ids before the shard)."""
    spark = df.sparkSession
    folder = new_path(spark, "tokens")
    if not shards:
        size = df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(vocabulary)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        ends: list[int] = []

        def docs():
            for b in chain([first], batches):
                ids = b.column("id").to_pylist()
                own = [x for x in ids if x is not None]
                ends[:] = [min(ends + own), max(ends + own)] if ends or own else []
                for doc_id, raw in zip(ids, enc.encode_many(b.column("text"))):
                    yield doc_id, raw + end

        path = f"{folder}/{part:05d}-{uuid.uuid4().hex}.zst"
        with _open(path, "w") as out:
            n, total = write_shard(out, docs())
        release_memory()
        low, high = ends or (None, None)
        yield pa.RecordBatch.from_pylist([{"shard": part, "path": path, "n_docs": n, "n_tokens": total, "low": low, "high": high}], pa.schema(fields))

    fields = [("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]
    rows = small_batches(df).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hash_ = F.xxhash64("text")
    repeats = df.groupBy(F.col(id_col)).count().agg(F.max("count"), F.sum("count")).first()
    hot = repeats[0] is not None and 2 * repeats[0] * shards > repeats[1]  # an id of half a shard or more is parted by its texts
    ranges = [F.col("id"), hash_] if hot else [F.col("id")]  # else finding the ranges reads no text
    ranged = rows.repartitionByRange(shards, *ranges).sortWithinPartitions(F.col("id"), hash_, F.col("text"))
    done = write_table(ranged.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long, low long, high long"), "manifest")
    before, out = 0, []
    for shard, path, n, total, low, high in sorted(done.collect()):  # one row per shard file
        out.append((shard, path, n, total, low, high, before))
        before += total
    return spark.createDataFrame(out, "shard int, path string, n_docs long, n_tokens long, low long, high long, start long")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, shard, place (and ids)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, path, start in zip(b["shard"], b["path"], b["start"]):
                with _open(path, "r") as file:
                    s = Shard(file)
                    starts = start + np.r_[0, np.cumsum(s.docs["n"])]
                    at = 0
                    while at < len(s.docs):
                        held = 4 * np.cumsum(s.docs["n"][at : at + 2_000])
                        places = range(at, at + max(1, int(np.searchsorted(held, READ_BYTES))))
                        ids = [s.read(k) for k in places]
                        out = {"doc_id": pd.array([int(s.docs["id"][k]) if s.docs["known"][k] else None for k in places], "Int64"), "start": starts[at : at + len(places)], "n_tokens": s.docs["n"][at : at + len(places)], "ids_crc32": [zlib.crc32(x) for x in ids], "shard": shard, "place": list(places)}
                        if with_ids:
                            out["ids"] = [np.frombuffer(x, "<u4").astype(np.int64) for x in ids]
                        yield pd.DataFrame(out)
                        at = places.stop

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, place long" + ", ids array<long>" * with_ids
    n = max(1, manifest.count())
    return manifest.repartition(n, "path").mapInPandas(read, schema)


def read_documents(manifest: DataFrame, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
    """The ids of the requested documents only, by seeking; for tools that need a few."""
    wanted, out = set(doc_ids), {}
    if not wanted:
        return out
    low, high = min(wanted), max(wanted)
    for row in manifest.where((F.col("low") <= high) & (F.col("high") >= low)).collect():
        if not any(row["low"] <= x <= row["high"] for x in wanted):
            continue
        with _open(row["path"], "r") as file:
            s = Shard(file)
            for k in np.flatnonzero(np.isin(s.docs["id"], list(wanted)) & s.docs["known"]):
                out[int(s.docs["id"][k])] = np.frombuffer(s.read(k), "<u4")
    return out

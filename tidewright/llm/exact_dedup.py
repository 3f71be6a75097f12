"""Exact deduplication by an extendible-hash index on shared files, with DataFrame functions only.

Texts are equal when identical after lower-casing A-Z.  A text's key is a 64-bit hash.  The directory comes first: from
the counts of distinct keys, a bucket that holds more than `capacity` keys is split by one more leading bit, again and
again, until none is overfull (a directory of equal-depth slots doubles with it; only the buckets themselves are stored,
so a deep bucket costs one row).  Every row then goes to the owner task of its bucket, a range of keys.  The owner
compares the bytes of the texts that share a key: equal texts become one entry of that key's chain, with the largest id
and their number, different ones are further entries.  The entries are written to one folder per bucket.  What a
document's row reports (keep_id, group_size) is read from the entry in the bucket that the directory names for its key.

Keys of very many copies (more than `HOT_COPIES` and than one in `HOT_SHARE` rows, so at most HOT_SHARE keys) are folded
map-side before they go to their owner, and looked up by a broadcast of their entries, so no task holds a hot group.

Defined results: null text counts as empty; an empty table gives an empty report; a null id is smaller than any other;
rows that repeat both id and text get equal report rows; `deduplicate` keeps one of them, the smallest by a hash of all
its columns; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_ascii, new_path, unused, write_table

#: Keys that a bucket of the index may hold before it is split: at least CAPACITY, and as many as keep the buckets at about BUCKETS.
CAPACITY, BUCKETS = 65_536, 1 << 15
#: Bytes of text that an owner compares, about; there are no fewer owners than shuffle partitions.
OWNER_BYTES = 256 << 20
#: Bits that one look at the counts covers.
STEP = 4
#: Copies from which a key counts as hot, and the share of all rows (one in so many) that it must exceed.
HOT_COPIES, HOT_SHARE = 64, 1 << 16


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """The buckets as (local depth, prefix), in key order, for a stored table of distinct keys (h).

    Reads counts per key prefix, only below overfull buckets: at most 2**STEP for each of keys / capacity buckets a round.
    """
    done: list[tuple[int, int]] = []
    full, depth = [0], 0  # prefixes of overfull buckets of that depth
    if keys.count() <= capacity:
        return [(0, 0)]
    while full:
        bits = min(64, depth + STEP)
        below = keys.select(_prefix(F.col("h"), depth).alias("p"), _prefix(F.col("h"), bits).alias("q"))
        below = below.join(F.broadcast(keys.sparkSession.createDataFrame([(p,) for p in full], "p long")), "p", "left_semi")  # keys / capacity rows at most
        counts = dict(below.groupBy("q").count().collect())
        for d in range(depth + 1, bits + 1):
            sizes: dict[int, int] = {}
            for q, n in counts.items():
                sizes[q >> bits - d] = sizes.get(q >> bits - d, 0) + n
            halves, full = [2 * p + x for p in full for x in (0, 1)], []
            for p in halves:
                if sizes.get(p, 0) > capacity and d < 64:
                    full.append(p)
                else:
                    done.append((d, p))
        depth = bits
    return sorted(done, key=lambda x: x[1] << 64 - x[0])


def slots(leaves: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int, int]]]:
    """The global depth and the directory's slots (slot, first slot of its bucket, local depth)."""
    deep = max(d for d, _ in leaves)
    return deep, [(s, p << deep - d, d) for d, p in leaves for s in range(p << deep - d, p + 1 << deep - d)]


def _place(rows: DataFrame, leaves: list[tuple[int, int]], owners: int) -> DataFrame:
    """rows (h, ...) with the bucket that the directory names for the key, and its owner: owners take runs of buckets, or a
    range of a bucket's keys where there are fewer buckets than owners."""
    table = [(d, p - (1 << 64) if p >> 63 else p, k) for k, (d, p) in enumerate(leaves)]
    table = rows.sparkSession.createDataFrame(table, "depth int, prefix long, bucket int")
    depths = sorted({d for d, _ in leaves})
    prefix = F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(h, 64 - depth)"))
    placed = rows.withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).withColumn("prefix", prefix)
    placed = placed.join(F.broadcast(table), ["depth", "prefix"])  # a row per bucket: about 2 * BUCKETS at most
    inside = F.expr("shiftrightunsigned(shiftleft(h, depth), 48)") / 65_536.0
    owner = F.floor((F.col("bucket") + inside) * owners / len(leaves)).cast("int")
    return placed.withColumn("owner", owner).drop("depth", "prefix")


class Index:
    """The written index: its entries, the directory's buckets, and the hot keys (h)."""

    def __init__(self, entries: DataFrame, leaves: list[tuple[int, int]], hot: DataFrame, keys: DataFrame):
        self.entries, self.leaves, self.hot, self.keys = entries, leaves, hot, keys


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, key: Callable[[Column], Column] = F.xxhash64, digest: Callable[[Column], Column] = _sha) -> Index:
    """Entries: bucket, h (key), chain (place among the texts of that key), digest, keep_id, group_size, clash (whether the key has
    several texts) and norm (the text, of those only).  keys: (doc_id, h) of every row.  capacity: None grows with the table."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("keep_id"), fold_ascii(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("h", key(F.col("norm")))
    keys = write_table(rows.select(F.col("keep_id").alias("doc_id"), "h", F.octet_length("norm").alias("size")), "keys")
    counts = write_table(keys.groupBy("h").agg(F.count("*").alias("count"), F.sum("size").alias("bytes")), "key-counts")
    n_keys, n_rows, n_bytes = counts.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // OWNER_BYTES))
    leaves = directory(counts, max(CAPACITY, n_keys // BUCKETS) if capacity is None else capacity)
    hot = write_table(counts.where(F.col("count") > max(HOT_COPIES, n_rows // HOT_SHARE)).select("h"), "hot")
    marked = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "h", "left")  # at most HOT_SHARE keys
    cold = marked.where("hot is null").select("h", "norm", "keep_id", F.lit(1).cast("long").alias("group_size"))
    folded = rows.join(F.broadcast(hot), "h", "left_semi").groupBy("h", "norm").agg(F.max("keep_id").alias("keep_id"), F.count("*").alias("group_size"))
    owned = _place(cold.unionByName(folded), leaves, owners).repartitionById(owners, F.col("owner"))
    entries = owned.groupBy("owner", "bucket", "h", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    chained = entries.selectExpr("*", "row_number() over (partition by owner, bucket, h order by norm) - 1 as chain", "count(*) over (partition by owner, bucket, h) > 1 as clash")
    path = new_path(spark, "index")
    out = chained.select("bucket", "h", "chain", digest(F.col("norm")).alias("digest"), "keep_id", "group_size", "clash", F.when(F.col("clash"), F.col("norm")).alias("norm"))
    out.sortWithinPartitions("bucket", "h", "chain").write.partitionBy("bucket").parquet(path)
    entries = spark.read.schema("h long, chain int, digest string, keep_id long, group_size long, clash boolean, norm string, bucket int").parquet(path)
    return Index(entries, leaves, hot, keys.drop("size"))


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, key: Callable[[Column], Column] = F.xxhash64, digest: Callable[[Column], Column] = _sha) -> DataFrame:
    """The entries of the index."""
    return index(df, id_col, text_col, capacity, key, digest).entries


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, key: Callable[[Column], Column] = F.xxhash64, digest: Callable[[Column], Column] = _sha) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest.  key and digest can be weakened to test collisions."""
    own = index(df, id_col, text_col, capacity, key, digest)
    entries, found = own.entries, ["doc_id", "keep_id", "group_size", "digest"]
    single = entries.where("not clash").select("bucket", "h", "keep_id", "group_size", "digest")
    keys = _place(own.keys, own.leaves, 1).drop("owner")
    hot = F.broadcast(own.hot)  # at most HOT_SHARE keys
    out = keys.join(hot, "h", "left_anti").join(single, ["bucket", "h"]).select(*found)
    hot_entries = F.broadcast(single.join(hot, "h", "left_semi"))  # at most HOT_SHARE entries
    out = out.unionByName(keys.join(hot_entries, ["bucket", "h"]).select(*found))
    chains = entries.where("clash").select("bucket", "h", "norm", "keep_id", "group_size", "digest")
    if not chains.isEmpty():  # keys of several texts: a document's entry is the one with its bytes
        rows = df.select(F.col(id_col).cast("long").alias("doc_id"), fold_ascii(F.col(text_col)).alias("norm"))
        rows = rows.withColumn("h", key(F.col("norm"))).join(chains.select("h").distinct(), "h", "left_semi")
        out = out.unionByName(_place(rows, own.leaves, 1).join(chains, ["bucket", "h", "norm"]).select(*found))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows that exact_dedup drops, its columns unchanged; of rows that repeat id and text one stays, the smallest by
    a hash of all its columns."""
    gone_id, gone_digest, twice_id, twice_digest, again = unused(df, "gone_id", "gone_digest", "twice_id", "twice_digest", "again")
    report = write_table(exact_dedup(df, id_col, text_col), "exact")
    dropped = report.where("not kept").select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_digest))
    repeated = report.where("kept").groupBy("doc_id", "digest").count().where("count > 1")
    mixed = report.groupBy("doc_id").agg(F.min("kept").alias("a"), F.max("kept").alias("b")).where("a <> b")
    if mixed.isEmpty() and repeated.isEmpty():
        return df.join(dropped.select(gone_id).distinct(), df[id_col].eqNullSafe(F.col(gone_id)), "left_anti")
    # ids that are not unique: decide on (id, text), then keep one of the repeated rows
    marked = df.withColumn(gone_digest, _sha(fold_ascii(df[text_col]))).withColumn(gone_id, df[id_col].cast("long"))
    same = marked[gone_id].eqNullSafe(dropped[gone_id]) & (marked[gone_digest] == dropped[gone_digest])
    left = marked.join(dropped.distinct(), same, "left_anti")
    twice = repeated.select(F.col("doc_id").alias(twice_id), F.col("digest").alias(twice_digest))
    same = left[gone_id].eqNullSafe(F.col(twice_id)) & (left[gone_digest] == F.col(twice_digest))
    once = left.join(twice, same, "left_anti").select(*df.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    groups = left.join(twice, same, "left_semi").groupBy(gone_id, gone_digest)
    kept = groups.agg(F.min_by(row, F.struct(F.xxhash64(F.to_json(row)), F.to_json(row))).alias(again))
    return once.unionByName(kept.select(*[F.col(f"{again}.`{c}`").alias(c) for c in df.columns]))

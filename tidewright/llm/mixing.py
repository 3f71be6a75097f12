"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions but for the count of words.

Each source gets a target number of words: its weight's share of all words, at most `cap` times what it has, the excess
reshared by weight.  A document of a source is expected e = min(cap, c * g) times, where g grows gently with the bits of
its size (1 + bits / 16) and c is such that the expected words meet the target.  The whole part of e are certain copies.
What is left, p = e - floor(e), is the document's inclusion probability in the sample: documents are ranked by random odds
over inclusion odds, u / (1 - u) over p / (1 - p) (Pareto order sampling, unequal probabilities), and the lowest ranks are
taken until the words that the certain copies leave open are used up, so a source's sample has a fixed size in words.

What closes the gap: documents that exceed the words left are passed over, and the order is followed further with the
documents that fit (`PHASES` times; each leaves less than the size of the document that stopped it); then one document
of those left over may follow, the one that brings the words nearest to the target.

No source is gathered in one task.  Where the words run out is found from histograms of the ranks, `BINS` sums a source,
bin by bin, until a bin holds at most `LEAF` documents.  Tables of one row a source are joined by source and salt, so a
source that holds a third of all rows is dealt over `SALTS` tasks; Spark broadcasts them instead where they are under
its own size bound.

Defined results: null text has size 0; documents without words are taken as often as their certain copies; a null source
is a source of its own and sorts last; a source without words gets target 0; rows that repeat an id have one rank, and
those of one rank are taken together or not at all (certain copies aside); an empty table gives an empty result; random
numbers are hashes of id and seed, so reruns agree in any partitioning.  `mix` keeps all other columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unused, write_table

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Sums of a source that a round of the search reads, documents in the last bin, and rounds that the ranks' bits allow.
BINS, LEAF, ROUNDS = 256, 4_096, 7
#: Times that the order is followed, each time with the documents that fit into the words left.
PHASES = 3
#: Tasks that one source's rows are dealt over in a join.
SALTS = 16


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def count_words(texts: pa.Array) -> pa.Array:
    """Of each text of a batch: bytes that are no white space, with white space or the text's start before them.  In UTF-8 a byte
    below 128 is a character."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    word = ~_SPACE[raw]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    starts[first] = word[first]
    return pa.array(np.diff(np.searchsorted(np.flatnonzero(starts), at)), pa.int64())


def size_of(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space; counted a batch at a time, since Spark's count of matches makes a string
    of each."""
    return F.arrow_udf(count_words, "long")(F.coalesce(text, F.lit("")))


def _of_source(rows: DataFrame, table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows (with source) joined to table (one row a source, whose source column is s; it is dropped)."""
    (salt, other) = unused(rows.join(table.limit(0)), "salt", "salt_b")
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    dealt = table.withColumn(other, F.explode(salts))
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int"))
    return rows.join(dealt, F.col("source").eqNullSafe(F.col("s")) & (F.col(salt) == F.col(other))).drop(salt, other, "s")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sizes (source, words) with target: weights by code-point order, repeating, nulls last; targets stop at cap * words."""
    # places in the order: rows of a range partition, after the counts of the ranges before (one number per range)
    ranged = write_table(sizes.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").sortWithinPartitions("last", "source").withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "sources")
    before, starts = 0, []
    for part, n in sorted(ranged.groupBy("part").count().collect()):
        starts.append((part, before))
        before += n
    starts = sizes.sparkSession.createDataFrame(starts, "part int, start long")
    place = F.col("start") + F.col("seq").bitwiseAND(F.lit((1 << 33) - 1))
    weighted = ranged.join(F.broadcast(starts), "part").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))  # one row a range
    weighted = write_table(weighted.select("source", "words", "weight"), "weights")
    rate = 0.0
    while True:  # each round caps more sources; the rate is one number
        at_cap = F.col("words") * cap <= F.col("weight") * rate
        free, used, total = weighted.agg(F.sum(F.when(at_cap, 0.0).otherwise(F.col("weight"))), F.sum(F.when(at_cap, F.col("words") * cap).otherwise(0.0)), F.sum("words")).first()
        new = (total - used) / free if free else rate
        if new <= rate:
            break
        rate = new
    return weighted.select("source", "words", F.least(F.col("words") * cap, F.col("weight") * rate).alias("target"))


def _likelier(size: Column) -> Column:
    """How much likelier a document of that size is taken: 1 + bits / 16."""
    return 1 + F.length(F.bin(size)) / 16.0


def _expected(size: Column, c: Column, cap: float) -> Column:
    """Expected copies of a document; c is null where the whole source is at the cap."""
    return F.when(c.isNull(), F.lit(cap)).otherwise(F.least(F.lit(cap), c * _likelier(size)))


def _rank(doc_id: Column, p: Column, seed: int) -> Column:
    """Random odds over inclusion odds, squeezed into (0, 1) without changing the order."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long")
    u = (bits.cast("double") + 0.5) / float(1 << 52)
    odds = F.try_divide(u / (1 - u), p / (1 - p))
    return odds / (1 + odds)


def expectations(sums: DataFrame, cap: float = CAP) -> DataFrame:
    """sums (source, words, target, classes: array of (bits, words)) with c and need, the words that certain copies leave open."""
    largest = F.reverse(F.array_sort("classes"))
    likelier = lambda x: 1 + x["bits"] / 16.0
    zero = F.lit(0.0)
    rest = F.aggregate("classes", zero, lambda acc, x: acc + x["words"] * likelier(x))

    def fold(acc: Column, x: Column) -> Column:
        """From the largest class on, those that would exceed the cap are put at the cap."""
        over = F.try_divide(F.col("target") - cap * acc["capped"], acc["rest"]) * likelier(x) > cap
        return F.struct((acc["capped"] + F.when(over, x["words"].cast("double")).otherwise(0.0)).alias("capped"), (acc["rest"] - F.when(over, x["words"] * likelier(x)).otherwise(0.0)).alias("rest"))

    out = sums.withColumn("fold", F.aggregate(largest, F.struct(zero.alias("capped"), rest.alias("rest")), fold))
    out = out.withColumn("c", F.when(F.col("target") < F.col("words") * cap, F.try_divide(F.col("target") - cap * F.col("fold.capped"), F.col("fold.rest"))))
    whole = lambda x: F.floor(F.when(F.col("c").isNull(), F.lit(cap)).otherwise(F.least(F.lit(cap), F.col("c") * likelier(x))))
    certain = F.aggregate("classes", F.lit(0).cast("long"), lambda acc, x: acc + x["words"] * whole(x))
    return out.withColumn("need", F.col("target") - certain).drop("fold", "classes")


def _edges(pool: DataFrame, limits: DataFrame) -> DataFrame:
    """For each source of limits (s, gap): edge, the first rank of pool (doc_id, source, rank, size) that the words of the ranks up
    to it exceed gap at (2 where none does), and used, the words below it."""
    state = limits.select("s", "gap", F.lit(0.0).alias("low"), F.lit(2.0).alias("width"), F.lit(0).cast("long").alias("before"))
    for _ in range(ROUNDS):
        here = _of_source(pool, state).where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("width")))
        bins = here.groupBy("source", F.floor((F.col("rank") - F.col("low")) / F.col("width") * BINS).cast("int").alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        bins = bins.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("bin", "words", "n"))).alias("bins"))  # BINS entries at most

        def walk(acc: Column, x: Column) -> Column:
            fits = (acc["bin"] < 0) & (acc["upto"] + x["words"] <= F.col("gap"))
            stops = (acc["bin"] < 0) & ~fits
            return F.struct((acc["upto"] + F.when(fits, x["words"]).otherwise(0)).alias("upto"), F.when(stops, x["bin"]).otherwise(acc["bin"]).alias("bin"), F.when(stops, x["n"]).otherwise(acc["n"]).alias("n"))

        start = F.struct(F.col("before").alias("upto"), F.lit(-1).alias("bin"), F.lit(0).cast("long").alias("n"))
        none = F.expr("cast(array() as array<struct<bin: int, words: bigint, n: bigint>>)")
        state = state.join(bins.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t")), "left").drop("t")
        state = state.withColumn("walk", F.aggregate(F.coalesce("bins", none), start, walk))
        found = F.col("walk.bin") >= 0
        low = F.when(found, F.col("low") + F.col("walk.bin") * (F.col("width") / BINS)).otherwise(F.col("low") + F.col("width"))
        state = write_table(state.select("s", "gap", low.alias("low"), F.when(found, F.col("width") / BINS).otherwise(0.0).alias("width"), F.col("walk.upto").alias("before"), F.col("walk.n").alias("n")), "bins")
        if (state.agg(F.max("n")).first()[0] or 0) <= LEAF:
            break
        state = state.drop("n")
    here = _of_source(pool, state.drop("n")).where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("width")))
    leaf = here.groupBy("source", "rank").agg(F.sum("size").alias("words")).groupBy(F.col("source").alias("t")).agg(F.array_sort(F.collect_list(F.struct("rank", "words"))).alias("leaf"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["edge"].isNull() & (acc["used"] + x["words"] <= F.col("gap"))
        return F.struct((acc["used"] + F.when(fits, x["words"]).otherwise(0)).alias("used"), F.coalesce(acc["edge"], F.when(~fits, x["rank"])).alias("edge"))

    none = F.expr("cast(array() as array<struct<rank: double, words: bigint>>)")
    out = state.join(leaf, F.col("s").eqNullSafe(F.col("t")), "left")
    out = out.withColumn("step", F.aggregate(F.coalesce("leaf", none), F.struct(F.col("before").alias("used"), F.lit(None).cast("double").alias("edge")), step))
    return write_table(out.select("s", "gap", F.coalesce("step.edge", F.col("low") + F.col("width")).alias("edge"), F.col("step.used").alias("used")), "edges")


def plan_sources(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 42) -> DataFrame:
    """rows (doc_id, source, size) to one row a source: s, words, target, c, phases (array of from, edge, gap), last_rank, last_size."""
    classes = rows.groupBy("source", F.length(F.bin("size")).alias("bits")).agg(F.sum("size").alias("words"))
    sums = classes.groupBy("source").agg(F.sum("words").alias("words"), F.collect_list(F.struct("bits", "words")).alias("classes"))  # 64 classes at most
    sums = write_table(sums, "sums")
    shares = targets(sums.select("source", "words"), weights, cap).select(F.col("source").alias("t"), "target")
    plan = expectations(sums.join(shares, F.col("source").eqNullSafe(F.col("t"))).drop("t"), cap)
    plan = write_table(plan.withColumnRenamed("source", "s"), "plan")
    e = _expected(F.col("size"), F.col("c"), cap)
    ranked = _of_source(rows.where("size > 0"), plan.select("s", "c")).withColumn("p", e - F.floor(e)).where("p > 0")
    pool = write_table(ranked.select("doc_id", "source", "size", _rank(F.col("doc_id"), F.col("p"), seed).alias("rank")), "ranked")
    state = plan.select("s", F.col("need").alias("gap"), F.lit(0.0).alias("edge"), F.expr("cast(array() as array<struct<from: double, edge: double, gap: double>>)").alias("phases"))
    for _ in range(PHASES):
        left = _of_source(pool, state.select("s", "gap", "edge")).where("rank >= edge and size <= gap").drop("gap", "edge")
        found = _edges(left, state.select("s", "gap")).select(F.col("s").alias("t"), F.col("edge").alias("next"), "used")
        both = state.join(found, F.col("s").eqNullSafe(F.col("t")))
        state = both.select("s", (F.col("gap") - F.col("used")).alias("gap"), F.col("next").alias("edge"), F.concat("phases", F.array(F.struct(F.col("edge").alias("from"), F.col("next").alias("edge"), "gap"))).alias("phases"))
    state = write_table(state, "phases")
    left = _of_source(pool, state.select("s", "gap", "edge")).where("rank >= edge").groupBy("source", "rank", "size", "gap").agg(F.sum("size").alias("words"))
    last = left.where("abs(gap - words) < gap").groupBy(F.col("source").alias("t")).agg(F.min(F.struct(F.abs(F.col("gap") - F.col("words")).alias("off"), "rank", "size")).alias("last"))
    state = state.join(last, F.col("s").eqNullSafe(F.col("t")), "left").select(F.col("s").alias("u"), "phases", F.col("last.rank").alias("last_rank"), F.col("last.size").alias("last_size"))
    return write_table(plan.join(state, F.col("s").eqNullSafe(F.col("u"))).drop("u", "need"), "sources")


def _once(value: Column) -> Column:
    """value as a generated row of its own: the optimizer does not carry it into filters and join conditions, where it would be
    computed again for each place it is used in."""
    return F.explode(F.array(value))


def _with_copies(rows: DataFrame, doc_id: Column, size: str, own: str, copies: str, cap: float, seed: int) -> DataFrame:
    """rows with their copies; own: the row of plan_sources of their source."""
    e, rank, told = unused(rows, "expected", "rank", "told")
    own, chance = F.col(own), F.col(e) - F.floor(F.col(e))
    rows = rows.withColumn(e, _expected(F.col(size), own["c"], cap))
    rows = rows.withColumn(rank, F.when((F.col(size) > 0) & (chance > 0), _rank(doc_id, chance, seed)))
    rows = rows.withColumn(told, _once(F.struct(F.col(e).alias("e"), F.col(rank).alias("rank")))).drop(e, rank)
    rank = F.col(told)["rank"]
    taken = F.exists(own["phases"], lambda x: (rank >= x["from"]) & (rank < x["edge"]) & (F.col(size) <= x["gap"]))
    taken = F.coalesce(taken, F.lit(False)) | F.coalesce((rank == own["last_rank"]) & (F.col(size) == own["last_size"]), F.lit(False))
    return rows.withColumn(copies, (F.floor(F.col(told)["e"]) + taken.cast("int")).cast("int")).drop(told)


def counts(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 42) -> DataFrame:
    """rows (doc_id, source, size; stored) with source_size, target and copies."""
    table = plan_sources(rows, weights, cap, seed)
    out = _of_source(rows, table.select("s", F.struct("words", "target", "c", "phases", "last_rank", "last_size").alias("own")))
    out = _with_copies(out, F.col("doc_id"), "size", "own", "copies", cap, seed)
    return out.select("doc_id", "source", "size", F.col("own.words").alias("source_size"), F.col("own.target").alias("target"), "copies")


def _sizes(df: DataFrame) -> DataFrame:
    return write_table(small_batches(df).select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(F.col("text")).alias("size")), "sizes")


def plan_mix(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    return counts(_sizes(df), weights, cap, seed).withColumn("taken", F.col("copies") * F.col("size"))


def mix(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 42) -> DataFrame:
    """The mixed documents: each row of df as often as the mix takes it, columns unchanged."""
    table = plan_sources(_sizes(df), weights, cap, seed)
    own, times, key, salt, other, size = unused(df, "own", "times", "s", "salt", "salt_b", "size")
    table = table.select(F.col("s").alias(key), F.struct("c", "phases", "last_rank", "last_size").alias(own))
    table = table.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = df.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = out.join(table, out["source"].eqNullSafe(F.col(key)) & (F.col(salt) == F.col(other))).withColumn(size, size_of(F.col("text"))).withColumn(size, _once(F.col(size)))
    out = _with_copies(out, F.col("doc_id").cast("long"), size, own, times, cap, seed).where(F.col(times) > 0)
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*df.columns)

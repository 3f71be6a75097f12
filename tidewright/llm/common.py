"""What the corpus operators share: the durable folder, written tables, ASCII folding and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space that separates words (ASCII only), as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"

_OWN_FOLDER: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master only, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_FOLDER:
            _OWN_FOLDER[app] = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        folder = _OWN_FOLDER[app]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/tidewright/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return the table that reads it back.

    This cuts the lineage durably: a lost executor costs no recomputation of what was written.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, after lowering the session's bound on the bytes of an Arrow batch: texts are long, and the default of 64 MB is held
    several times over, in the JVM's direct memory and in each worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    try:
        now = int("".join(c for c in conf.get(name) if c.isdigit()) or 0)
    except PySparkException:  # a version without this setting
        return df
    if not 0 < now <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker outlives its task and shares the executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()  # Arrow's buffers are not the C library's
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty.  Pure ASCII texts take the fast built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


#: Edges up to which a round of the components is one task's, without an exchange; longer lists are dealt by their nodes.
ONE_TASK = 100_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list (src, dst) of longs.

    Returns (node, component) with component the smallest node reachable, for every node that has an edge to another
    node.  Alternates large-star and small-star rounds until the edge list repeats itself; each round is written to
    the shared folder.  Minima are pre-aggregated before they are shuffled, so a hub costs one row per task.
    """

    def stored(e: DataFrame) -> tuple[DataFrame, tuple]:
        """The table and its number and hash of edges, which are gathered as it is written."""
        seen = Observation()
        table = write_table(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")), "edges")
        return table, (seen.get["n"], seen.get["h"])

    edges, before = stored(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    for _ in range(max_rounds):
        if not before[0]:
            break
        few = before[0] <= ONE_TASK
        both = (edges.coalesce(1) if few else edges).select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))
        low = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.where("dst > src").join(low.hint("merge"), "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        large = large.coalesce(1) if few else large
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        joined = large.join(low.hint("merge"), "src")
        small = joined.select(F.inline(F.array(F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")), F.struct("src", F.col("low").alias("dst")))))
        edges, after = stored(small.where("src <> dst").distinct())
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    stars = edges.groupBy("src").agg(F.min("dst").alias("component")).select(F.col("src").alias("node"), "component")
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.unionByName(roots)

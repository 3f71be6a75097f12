"""The corpus pipeline: toxic documents go, then exact copies, then near copies; sources are mixed to target weights; the
rest is written as SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever
further columns there are and whatever their names.  `run` writes each stage's result to the shared folder and gives it to
the next one.  An empty table passes all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import exact_dedup, mixing, pieces, simhash, toxicity
from tidewright.llm.common import documents, write_table
from tidewright.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold of their language.  The classifier learns from the labels table.

    Null and empty texts have the score of a text without words; equal texts of one language stay or go together; rows with a
    null id are scored like any other; without usable labels the score is a constant, and at 0 all documents stay.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the row with the largest doc_id.

    Null counts as empty; a null id is smaller than any other; of rows that repeat id and text the smallest by a hash of all
    columns stays.
    """
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more), the smallest doc_id.

    A text of fewer than five words is one shingle, so short texts are near copies when their words are equal; null and empty
    texts are one group; rows with a null id stay.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; copies are repeated rows.

    A null source is a source of its own; documents without words are taken as often as their certain copies; rows that
    repeat an id have one rank in the sample.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled SentencePiece ids of each document.

    Null and empty texts have no ids; the sample is seeded by the id, so repeated rows get equal ids; a null id is a seed too.
    """
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The classifier and the sampler have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(docs, name.replace(" ", "-"))
    return docs

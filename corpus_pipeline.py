"""A corpus pipeline: toxic documents go, exact copies go, of near copies one stays, the sources
are mixed to target weights, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of ``documents``, further
columns too, whatever their names. In every stage null texts count as empty, rows with a null id are
rows like any other, and an empty table gives no rows; what ties and repeated rows do is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import exact_dedup, mixing, packing, simhash, toxicity
from waymark.llm._common import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most toxic window scores 0.5 or more go. Empty texts stay; repeated rows stay
    or go alike; without labels of both kinds none go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays (a null id is below all others; of
    repeated rows one). All empty texts are equal."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the least id stays (a null id only where
    all are null; of repeated ids the first row)."""
    return simhash.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or up to three times. Texts
    without a word are never taken; a null source is a source; a source of any size takes its target."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; an empty text is one token."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Toxicity and near-duplicate components have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

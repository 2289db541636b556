"""A corpus pipeline of five stages, each calling one of the training-data operators.

Language ID drops documents without a language; the Jaccard join keeps one document of
each group of near copies; personal data is replaced; sources are mixed to
target weights; what the mix takes is encoded. Each stage works on all that the one before
kept and is written as Parquet before the next. All but the last return the columns of
``documents``, with ``n_chars`` brought up to date where the text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from junctura.functions.checkpoints import shared_table
from junctura.llm import op3_jaccard_join, op4_language_id, op6_sentencepiece, op7_pii, op8_mixing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language; those without text or letters are rejected."""
    net = op4_language_id.fit(docs, "doc_id", "text", "lang")
    said = op4_language_id.with_language(docs, "text", net, "__said")
    return said.filter(F.col("__said.language") != op4_language_id.UNKNOWN).drop("__said")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; documents without an id or without words are kept."""
    return op3_jaccard_join.first_of_each(docs, "doc_id", "text")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts."""
    return op7_pii.redact_pii(docs, "text").withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, not at all or up to twice."""
    return op8_mixing.mixed_documents(docs, "doc_id", "text", "source")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document of the mix."""
    return op6_sentencepiece.encode_texts(docs, "doc_id", "text")


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: The stages train a network, search lattices and fit knapsacks; SQL can't say that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), group_bytes=8 << 20)
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to packed sequences: five stages, each a DataFrame of what the one before kept.

Every function takes (spark, docs, sf_dir).  All but the last return documents
with the columns they came with; the last returns the pieces of the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowsift.llm import mixing, ngram_join, packing, quality, tokens, toxicity
from flowsift.session import cut_lineage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality.passing(docs)


def harmless_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, by a model of the labelled documents."""
    return toxicity.acceptable(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document that is taken twice comes twice."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies."""
    return packing.pack(docs, tokens.vocabulary())


STAGES = [
    ("quality rules", good_documents),
    ("toxicity", harmless_documents),
    ("n-gram Jaccard join", distinct_documents),
    ("mixing sources", mixed_documents),
    ("packing", packed_sequences),
]

#: A tokenizer and a fitted model are not SQL; tests/llm compares with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

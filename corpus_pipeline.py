"""A corpus made ready for training: toxic documents out, copies out, near copies out, sources
balanced, and texts turned into sampled pieces.

Each stage reads what its predecessor kept from a table in the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancewright.llm import exact_dedup, mixing, ngram_join, sp_sampling, toxicity
from stancewright.llm.catalog import margins, table, toxic_categories
from stancewright.llm.scratch import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    chain = toxicity.train_chain(docs, table(spark, sf_dir, "labels"), toxic_categories())
    return toxicity.keep_accepted(docs, chain)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_copies(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the shingle join the document with the smallest id."""
    return ngram_join.keep_one(docs, width=5, percent=75)


def balance(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled towards flatter shares of source, language and topic."""
    return mixing.keep_sampled(docs, margins(), power=0.9, seed=2)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with two sampled segmentations, a row for each."""
    return sp_sampling.sample(docs, k=2, seed=10, with_row=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", balance),
    ("sentencepiece", segment),
]

#: Training, raking and noise have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

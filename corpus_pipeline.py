"""A corpus pipeline in stages: each works on what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridstats.llm import minhash, mixing, packing, toxicity
from gridstats.llm.queries import table, vocabulary
from gridstats.sources import keep


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, fitted on the labels, calls toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 1024 tokens."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("toxic", toxic),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]
#: Hashing, tokens and draws cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

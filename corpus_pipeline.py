"""From raw documents to a training mix, in stages that each write what they keep.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns it
was given; the last one returns them as often as the mix takes them, numbered in ``copy``.
Each works on all its predecessor kept. An empty table goes through all stages as one.

In every stage a null text counts as an empty one, a null id is an id of its own kind that
stays only where no other does, other columns come out as they went in whatever their names
are, and of rows that repeat id and text the stages from exact dedup on keep the same one in
every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidecast.llm import decontaminate, exact, mixing, simhash, toxicity
from tidecast.llm.common import landed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at or above the toxicity threshold go."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact.one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that SimHash finds to be 0.8 alike, by shingles of five words, one stays.

    It is the document with the smallest id; a null id stays only where there is no other.
    """
    return simhash.one_of_similar(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: Fitted scores and fingerprint components have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A pipeline over ``documents``: five stages, each one of the operators, each reading what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspan.llm import byte_repeats, contamination, languages, mixing, near_copies
from tallyspan.llm._base import scratch_path, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known for at least half of their letters."""
    return languages.accepted(docs, languages.train(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8."""
    return near_copies.keep_one_each(docs, width=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes of strings of 100 bytes that stand earlier too."""
    return byte_repeats.clean_documents(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return contamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources by weight, in random order."""
    return mixing.mix_sources(docs, mixing.WEIGHTS)


STAGES = [
    ("language", known_language),
    ("near copies", one_of_near_copies),
    ("repeats", without_repeats),
    ("decontamination", without_benchmarks),
    ("mixture", mixed),
]

#: Language identification, MinHash and suffix arrays are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        out = step(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = scratch_path(spark, f"stage-{i}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

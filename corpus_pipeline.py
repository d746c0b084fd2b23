"""A corpus pipeline: documents in, a mix for training out.

Each stage is one operator of `tollway.llm` over all documents its predecessor kept. Between
stages the documents are a table, so a lost executor costs no more than one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.llm import decontamination, jaccard_join, line_dedup, mixing, quality_rules
from tollway.llm.columns import free_name, store, table, where_computed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three lines in a row go, and documents of which nothing is left."""
    edited = line_dedup.without_repeats(docs)
    left = where_computed(
        edited,
        (F.col("n_removed") < F.col("n_lines")) | (F.col("n_removed") == 0),
        free_name(edited, "row"),
    )
    return left.select(
        *[
            F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`")
            for c in docs.columns
        ]
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an item of the benchmark go."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets the rate at which it is read; toxic ones get next to nothing."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: The rates are the end of an iteration over all documents, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

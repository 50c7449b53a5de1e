"""The corpus pipeline: quality, exact and near duplicates, mixture, packed sequences.

Every stage takes what its predecessor kept as a table of documents and returns one; the last
returns packed pieces. Rows and columns of ``documents`` stay as they are: the quality classifier
and the two deduplications drop rows, the mixture repeats some. Nulls, empty and long texts,
repeated rows and empty tables are handled as each operator's module says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgate.llm import bagminhash, grace_dedup, mixing, packing, quality
from textgate.llm.common import read_table, written
from textgate.llm.registry import packing_files


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = read_table(spark, sf_dir, "labels")
    model = quality.fit(quality.learnable(docs), quality.learnable(labels))
    return docs.where(quality.scored(F.col("text"), model) >= 0.5)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return grace_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return bagminhash.deduplicated(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to the repetition limit."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents."""
    return packing.pack(docs, packing_files())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No stage's result can be stated in SQL as a whole; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

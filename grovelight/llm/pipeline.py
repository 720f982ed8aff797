"""Stages of the corpus pipeline and how they are run one after the other."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from . import decontam, jaccard, language_id, mixing, substrings
from .common import scratch, table

Stage = tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]


def in_known_language(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents whose language is not rejected stay."""
    return language_id.in_known_language(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Texts lose the passages that documents with smaller ids hold; n_chars follows."""
    return substrings.with_kept_text(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents with a twentieth of their words or more in benchmark windows go."""
    return decontam.drop_contaminated(docs, table(spark, sf, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents that the mix takes, with the number of their copies."""
    return mixing.mixed_documents(docs)


STAGES: list[Stage] = [
    ("language_id", in_known_language),
    ("near_duplicates", one_of_each),
    ("substring_dedup", without_repeats),
    ("decontamination", clean_of_benchmarks),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf: str, stages: Sequence[Stage] = STAGES) -> DataFrame:
    place = scratch(spark)
    docs = table(spark, sf, "documents")
    for name, stage in stages:
        docs = place.cut(stage(spark, docs, sf), name)
    return docs

"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again for the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grovelight.llm import pipeline

STAGES = pipeline.STAGES

# Language identification and the compression sizes it rests on have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.run(spark, sf_dir, STAGES)

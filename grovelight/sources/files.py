"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_corpus_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Header CSV whose quoted texts may hold line breaks and doubled quotes."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .csv(path if isinstance(path, str) else list(path))
    )


def write_corpus_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per line; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_vectors(spark: SparkSession, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    return spark.read.parquet(path).select(
        F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")
    )


SCORE_KEYS = ("embedding_model", "reduction_method", "cluster_method", "level")


def write_scores(
    df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", keys: Sequence[str] = SCORE_KEYS
) -> None:
    """The score table in key order."""
    writer = df.orderBy(*keys).write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def read_tagged(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str, pattern: str, group: int = 1
) -> DataFrame:
    """Many score files as one table; the data set name is taken from the file path."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .csv(paths if isinstance(paths, str) else list(paths))
        .withColumn("dataset", F.regexp_extract(F.col("_metadata.file_path"), pattern, group))
    )

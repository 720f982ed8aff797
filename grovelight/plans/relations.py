"""The relations the registered queries run on, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")
    )


def point_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        (F.col("label") % 2).cast("string").alias("category_0"),
        F.col("label").cast("string").alias("category_1"),
    )


def flat_points(spark: SparkSession, sf: str, dims: int = 2) -> DataFrame:
    """The first coordinates of the vectors: a stand-in for a reduction."""
    return points(spark, sf).select("id", F.slice("vec", 1, dims).alias("vec"))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("topic"),
        F.col("lang").alias("category_0"),
        F.col("source").alias("category_1"),
    )


def hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    places = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"),
        F.col("r_name").alias("category_0"),
        F.col("n_name").alias("category_1"),
        F.col("c_mktsegment").alias("category_2"),
    )


def flat_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("target"), F.col("p_brand").alias("pred")
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """A score table keyed by (model, reduction, clusterer, level), averaged from line items."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("embedding_model"),
            F.col("l_linestatus").alias("reduction_method"),
            F.col("l_linenumber").cast("string").alias("cluster_method"),
            F.year("l_shipdate").cast("int").alias("level"),
        )
        .agg(
            F.round(F.avg("l_discount"), 6).alias("ari"),
            F.round(F.avg("l_tax"), 6).alias("ami"),
            F.round(F.avg("l_quantity"), 6).alias("fm"),
            F.round(F.avg("l_extendedprice"), 4).alias("dendrogram_purity"),
        )
    )


# The same relations for the SQL side, as common table expressions.
POINTS_CTE = "points AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
LOW_CTE = "low AS (SELECT vec_id AS id, CAST(embedding[1:2] AS DOUBLE[]) AS vec FROM embeddings)"
CORPUS_CTE = "corpus AS (SELECT doc_id AS id, text AS topic, lang AS category_0, source AS category_1 FROM documents)"
HIER_CTE = (
    "hier AS (SELECT c_custkey AS id, r_name AS category_0, n_name AS category_1, c_mktsegment AS category_2 "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
)
FLAT_CTE = "flat AS (SELECT p_partkey AS id, p_type AS target, p_brand AS pred FROM part)"
SCORES_CTE = """scores AS (
  SELECT l_returnflag AS embedding_model, l_linestatus AS reduction_method,
         CAST(l_linenumber AS VARCHAR) AS cluster_method, CAST(year(l_shipdate) AS INTEGER) AS level,
         round(avg(l_discount), 6) AS ari, round(avg(l_tax), 6) AS ami,
         round(avg(l_quantity), 6) AS fm, round(avg(l_extendedprice), 4) AS dendrogram_purity
  FROM lineitem GROUP BY 1, 2, 3, 4)"""

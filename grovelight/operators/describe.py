"""Short descriptions of clusters from their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import ASCII_SPACE
from ..sources.scratch import Scratch


def describe_clusters(texts: DataFrame, m: int = 5) -> DataFrame:
    """The ``m`` terms with the highest class-based weight per cluster: ``(cluster, rank, term, weight)``.

    ``weight = tf / terms of the cluster * ln(1 + average terms per cluster / tf over all clusters)``.
    Terms are counted before anything is ranked, so a large cluster sends its vocabulary, not its text; the counts are
    written, so that the texts are parted once.
    """
    # only what ASCII_SPACE parts is a word: splitting is many times faster than extracting, and leaves an empty end at most
    parted = F.split(F.lower("text"), f"[{ASCII_SPACE}]+")
    words = texts.select("cluster", F.explode(parted).alias("term")).where("term <> ''")
    counts = Scratch(texts.sparkSession).cut(words.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("tf")), "counts")
    overall = counts.groupBy("term").agg(F.sum("tf").alias("all_tf"))
    sizes = counts.groupBy("cluster").agg(F.sum("tf").alias("terms"))
    average = sizes.agg(F.avg("terms"))
    weighted = counts.join(overall, "term").join(sizes, "cluster").withColumn("avg_terms", average.scalar())
    weight = F.col("tf") / F.col("terms") * F.log(1 + F.col("avg_terms") / F.col("all_tf"))
    ranked = weighted.withColumn("weight", F.round(weight, 9))
    order = W.partitionBy("cluster").orderBy(F.desc("weight"), "term")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= m).select("cluster", "rank", "term", "weight")

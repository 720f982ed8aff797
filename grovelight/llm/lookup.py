"""A join of many rows with one row per key, where a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LEAST = 1000
MOST_HOT = 20_000


def lookup(rows: DataFrame, key: str, table: DataFrame, counted: str, spread_by: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has each key once (null is a key too) and the number of its rows in ``counted``.

    Rows of a key with more than a bounded number of rows are dealt out by ``spread_by``, and its row of ``table`` is copied as often. Such keys
    are broadcast: there can be no more than ``MOST_HOT`` of them.
    """
    total = table.agg(F.sum(counted)).first()[0] or 0
    limit = max(LEAST, -(-total // MOST_HOT))
    hot = F.broadcast(table.where(F.col(counted) > limit).select(F.col(key).alias("_hot"), F.ceil(F.col(counted) / limit).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(hot, F.col(key).eqNullSafe(F.col("_hot")), "left").withColumn("_part", F.pmod(F.xxhash64(spread_by), parts).cast("int"))
    right = table.drop(counted).join(hot, F.col(key).eqNullSafe(F.col("_hot")), "left").withColumn("_at", F.explode(F.sequence(F.lit(0), parts - 1)))
    right = right.withColumnRenamed(key, "_key").drop("_hot", "_parts")
    met = left.drop("_hot", "_parts").join(right, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")))
    return met.drop("_part", "_at", "_key")

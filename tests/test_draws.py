"""Draws are permutations, repeat, and spread evenly."""

import pytest
from pyspark.sql import functions as F

from grovelight.operators import reductions as rd
from grovelight.operators.prep import hashed


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_whole_permutations(spark, n):
    rows = rd._draws(spark.range(3), ["id"], n, n, 5, "t").groupBy("id").agg(F.count_distinct("pos").alias("u"), F.min("pos").alias("a"), F.max("pos").alias("b")).collect()
    assert [(r["u"], r["a"], r["b"]) for r in rows] == [(n, 0, n - 1)] * 3


def test_draws_spread_evenly(spark):
    n, count, rows = 1000, 8, 1500
    drawn = rd._draws(spark.range(rows), ["id"], n, count, 5, "t").cache()
    seen = [r["n"] for r in drawn.groupBy((F.col("pos") / 10).cast("int")).agg(F.count(F.lit(1)).alias("n")).collect()]
    expected = rows * count / 100
    assert len(seen) == 100 and sum((s - expected) ** 2 / expected for s in seen) < 160  # chi-square, 99 degrees: beyond 99.99 %
    # gaps between the draws of one row: a tenth of all distances, not a constant step
    a = drawn.where("nth = 0").select("id", F.col("pos").alias("a"))
    gaps = drawn.where("nth = 1").join(a, "id").select(F.pmod(F.col("pos") - F.col("a"), F.lit(n)).alias("g"))
    cells = [r["n"] for r in gaps.groupBy((F.col("g") / 100).cast("int")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(cells) == 10 and sum((c - rows / 10) ** 2 / (rows / 10) for c in cells) < 35  # 9 degrees
    again = rd._draws(spark.range(rows), ["id"], n, count, 5, "t")
    assert again.exceptAll(drawn).count() == 0


def test_draws_follow_the_hash_rule_and_use_all_cores(spark):
    """The same positions as ``hashed`` gives turn by turn, from a table that lies in one partition, whole or in two parts."""
    n, rows = 37, spark.range(0, 40, 1, 1)
    whole = rd._draws(rows, ["id"], n, 9, 5, "t")
    assert whole.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    state = rows.withColumn("key", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("t:5")))).withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(8))))
    state = state.withColumn("pos", F.col("nth").cast("long"))
    for turn in range(rd.TURNS):
        mirror = F.pmod(hashed(F.col("key"), F.lit(turn)) - F.col("pos"), F.lit(n)).cast("long")
        swap = hashed(F.col("key"), F.lit(turn), F.greatest(F.col("pos"), mirror)) % 2 == 1
        state = state.withColumn("pos", F.when(swap, mirror).otherwise(F.col("pos"))).localCheckpoint()
    expected = state.select("id", "nth", "pos")
    both = rd._draws(rows, ["id"], n, 4, 5, "t").unionByName(rd._draws(rows, ["id"], n, 9, 5, "t", 4))
    for found in (whole, both):
        assert found.count() == 360 and found.exceptAll(expected).count() == 0

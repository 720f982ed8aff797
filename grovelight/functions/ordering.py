"""Global positions and ranks without sending all rows through one task.

A window without ``PARTITION BY`` sorts everything in one task. Here rows are dealt into key ranges, as many as the
session shuffles into, and written once; each range is numbered by its own task, and the small table of range totals
supplies the offsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.scratch import Scratch


def with_running_totals(df: DataFrame, key: Column, weights: Mapping[str, Column]) -> DataFrame:
    """Add the total weight, one column for each of ``weights``, of all rows before this one in ascending key order (distinct keys, null first)."""
    weighed = {f"_weight{i}": w for i, w in enumerate(weights.values())}
    keyed = df.withColumns({"_key": key, **weighed}).repartitionByRange("_key")
    # written, so that every later step sees the same ranges and the input is read once
    cut = Scratch(df.sparkSession).cut(keyed.withColumn("_range", F.spark_partition_id()), "ranges")
    totals = cut.groupBy("_range").agg(*[F.sum(w).alias(f"_total{w}") for w in weighed])
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_total{w}").over(before), F.lit(0)).alias(f"_offset{w}") for w in weighed])
    inside = W.partitionBy("_range").orderBy("_key").rowsBetween(W.unboundedPreceding, -1)
    placed = cut.join(F.broadcast(offsets), "_range")  # one row per range
    for out, w in zip(weights, weighed):
        placed = placed.withColumn(out, F.col(f"_offset{w}") + F.coalesce(F.sum(w).over(inside), F.lit(0)))
    return placed.drop("_range", "_key", *weighed, *[f"_offset{w}" for w in weighed])


def with_running_total(df: DataFrame, key: Column, weight: Column, out: str) -> DataFrame:
    """``with_running_totals`` of one weight."""
    return with_running_totals(df, key, {out: weight})


def with_position(df: DataFrame, key: Column, out: str) -> DataFrame:
    """Add the 0-based position of each row in ascending key order (distinct keys)."""
    return with_running_total(df, key, F.lit(1), out).withColumn(out, F.col(out).cast("long"))


def value_ranks(df: DataFrame, value: str, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value with its tie-averaged ascending rank: ``(*by, value, n, rank)``.

    ``weight`` counts a row several times. Ranks run over distinct values, so heavy ties are reduced
    by the aggregation before anything is sorted. Groups are ranked together: they follow each other
    in one global order, and every group starts again from its own first value.
    """
    by = list(by)
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.sum(weight if weight is not None else F.lit(1)).cast("double").alias("n")
    )
    key = F.struct(*by, value) if by else F.col(value)
    placed = with_running_total(counted, key, F.col("n"), "_before")
    if by:
        starts = placed.groupBy(*by).agg(F.min("_before").alias("_start"))
        placed = placed.join(starts, by).withColumn("_before", F.col("_before") - F.col("_start"))
    return placed.select(*by, value, "n", (F.col("_before") + (F.col("n") + 1) / 2).alias("rank"))


def with_value_rank(df: DataFrame, value: str, out: str, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Add each row's tie-averaged ascending rank within its group; ``weight`` counts a row several times.

    Equal values never lie in two ranges, so ties are averaged where they are and nothing is joined back but one number per
    range and group.
    """
    by = list(by)
    keyed = df.withColumn("_weight", (weight if weight is not None else F.lit(1)).cast("double")).repartitionByRange(*by, value)
    cut = Scratch(df.sparkSession).cut(keyed.withColumn("_range", F.spark_partition_id()), "ranges")
    totals = cut.groupBy(*by, "_range").agg(F.sum("_weight").alias("_total"))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*by, "_range", F.coalesce(F.sum("_total").over(before), F.lit(0.0)).alias("_offset"))
    upto = W.partitionBy("_range", *by).orderBy(value).rangeBetween(W.unboundedPreceding, W.currentRow)
    tied = F.sum("_weight").over(W.partitionBy("_range", *by, value))
    placed = cut.join(F.broadcast(offsets), ["_range", *by])  # one row per range and group
    rank = F.col("_offset") + F.sum("_weight").over(upto) - tied + (tied + 1) / 2
    return placed.withColumn(out, rank).drop("_range", "_offset", "_weight")


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Linearly interpolated quantiles ``(*by, q0, q1, …)`` from global ranks, so that a large group
    is never sorted or held by one task."""
    by = list(by)
    ranked = value_ranks(df, value, by=by).withColumn("first", F.col("rank") - (F.col("n") + 1) / 2)
    sizes = ranked.groupBy(*by).agg(F.sum("n").alias("_total"))
    placed = ranked.join(sizes, by)
    covers = lambda at: (F.col("first") <= at) & (at < F.col("first") + F.col("n"))
    picked = []
    for number, share in enumerate(shares):
        at = F.round((F.col("_total") - 1) * share, 9)
        picked += [
            F.max(F.when(covers(F.floor(at)), F.col(value))).alias(f"_lo{number}"),
            F.max(F.when(covers(F.ceil(at)), F.col(value))).alias(f"_hi{number}"),
            F.max(at - F.floor(at)).alias(f"_part{number}"),
        ]
    ends = placed.groupBy(*by).agg(*picked)
    return ends.select(
        *by, *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}")).alias(f"q{i}") for i in range(len(shares))]
    )

"""Flat clustering scores. All work on counts, so only the first aggregation sees the rows.

Every operator takes ``by``: columns such as method or level, scored side by side in one job.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import ln_overlap_chance

EMI_CHUNK = 8192
EMI_SIZES = 1_000  # different cluster sizes that one side of a grid cell holds
NIL = 800.0  # exp(-746) is zero in doubles: less likely overlaps add nothing


def aligned_labels(target: DataFrame, pred: DataFrame, on: Sequence[str] = ("id",)) -> DataFrame:
    """Pair both label tables on the id; rows without a target label do not count."""
    return target.where(F.col("target").isNotNull()).join(pred, list(on), "inner")


def contingency(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Joint counts of ``target`` and ``pred``."""
    return labels.groupBy(*by, "target", "pred").agg(F.count(F.lit(1)).alias("n_ij"))


def _margins(cells: DataFrame, side: str, by: Sequence[str]) -> DataFrame:
    return cells.groupBy(*by, side).agg(F.sum("n_ij").alias("c")).drop(side)


def pair_sums(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sums over the contingency table that all pair-counting scores share, in doubles."""
    parts = [
        cells.select(*by, F.lit("ij").alias("kind"), F.col("n_ij").alias("c")),
        _margins(cells, "target", by).withColumn("kind", F.lit("a")),
        _margins(cells, "pred", by).withColumn("kind", F.lit("b")),
    ]
    c = F.col("c").cast("double")
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])

    def total(kind: str, value: Column) -> Column:
        return F.sum(F.when(F.col("kind") == kind, value).otherwise(F.lit(0.0)))

    falling = c * (c - 1) * (c - 2)
    plogp = c * F.log(c)
    return stacked.groupBy(*by).agg(
        total("ij", c).alias("n"),
        total("ij", c * c).alias("s_ij"),
        total("a", c * c).alias("s_a"),
        total("b", c * c).alias("s_b"),
        total("a", falling).alias("pc"),
        total("b", falling).alias("qc"),
        total("ij", plogp).alias("l_ij"),
        total("a", plogp).alias("l_a"),
        total("b", plogp).alias("l_b"),
        F.sum(F.when(F.col("kind") == "a", 1).otherwise(0)).alias("n_targets"),
        F.sum(F.when(F.col("kind") == "b", 1).otherwise(0)).alias("n_preds"),
    )


def _or_null(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator)


def fm_column() -> Column:
    t, p, q = F.col("s_ij") - F.col("n"), F.col("s_a") - F.col("n"), F.col("s_b") - F.col("n")
    return F.coalesce(_or_null(t, F.sqrt(p) * F.sqrt(q)), F.lit(0.0))


def expected_fm_column() -> Column:
    n, p, q = F.col("n"), F.col("s_a") - F.col("n"), F.col("s_b") - F.col("n")
    return _or_null(F.sqrt(p) * F.sqrt(q), n * (n - 1))


def variance_fm_column() -> Column:
    """Variance of the index when labels are paired at random; null where a factor vanishes."""
    n, pc, qc = F.col("n"), F.col("pc"), F.col("qc")
    p, q = F.col("s_a") - n, F.col("s_b") - n
    n2 = n * (n - 1)
    n3 = n2 * (n - 2)
    n4 = n3 * (n - 3)
    value = (
        F.lit(2.0) / n2
        + F.lit(4.0) * (pc / p) * (qc / q) / n3
        + (p - 2 - F.lit(4.0) * pc / p) * (q - 2 - F.lit(4.0) * qc / q) / n4
        - (p / n2) * (q / n2)
    )
    return F.when((n > 3) & (p > 0) & (q > 0), value)


def rand_column() -> Column:
    n = F.col("n")
    off = F.col("s_a") + F.col("s_b") - 2 * F.col("s_ij")
    return F.coalesce(1 - _or_null(off, n * (n - 1)), F.lit(1.0))


def adjusted_rand_column() -> Column:
    n = F.col("n")
    tp = F.col("s_ij") - n
    fn, fp = F.col("s_a") - F.col("s_ij"), F.col("s_b") - F.col("s_ij")
    tn = n * (n - 1) - tp - fn - fp
    value = _or_null(2 * (tp * tn - fn * fp), (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))
    return F.when((fn == 0) & (fp == 0), F.lit(1.0)).otherwise(value)


def fm_index(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return pair_sums(contingency(labels, by), by).select(*by, fm_column().alias("fm"))


def fm_moments(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Index, expected value and variance. All three are null when any label is null."""
    marked = labels.withColumn("_gap", F.col("target").isNull() | F.col("pred").isNull())
    gaps = (
        contingency(marked, [*by, "_gap"]).groupBy(*by).agg(F.max("_gap").alias("_gap"))
        if by
        else marked.agg(F.max("_gap").alias("_gap"))
    )
    sums = pair_sums(contingency(labels, by), by)
    joined = sums.join(gaps, list(by)) if by else sums.withColumn("_gap", gaps.scalar())
    whole = ~F.col("_gap")
    return joined.select(
        *by,
        F.when(whole, fm_column()).alias("fm"),
        F.when(whole, expected_fm_column()).alias("e_fm"),
        F.when(whole, variance_fm_column()).alias("v_fm"),
    )


def fm_significance(labels: DataFrame, by: Sequence[str] = (), z: float = 1.645) -> DataFrame:
    threshold = F.col("e_fm") + z * F.sqrt(F.col("v_fm"))
    return fm_moments(labels, by).select(
        *by, "fm", threshold.alias("threshold"), (F.col("fm") > threshold).alias("significant")
    )


def bk_curve(labels_a: DataFrame, labels_b: DataFrame) -> DataFrame:
    """``fm_moments`` at every number of clusters both sides have: tables ``(k, id, cluster)``."""
    a = labels_a.select("k", "id", F.col("cluster").alias("target"))
    b = labels_b.select("k", "id", F.col("cluster").alias("pred"))
    return fm_moments(a.join(b, ["k", "id"]), ["k"])


def rand_index(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return pair_sums(contingency(labels, by), by).select(*by, rand_column().alias("rand"))


def adjusted_rand(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return pair_sums(contingency(labels, by), by).select(*by, adjusted_rand_column().alias("ari"))


def expected_mutual_info(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean mutual information of random labelings with the same margins.

    Clusters of equal size share one term, so the work depends on distinct sizes. The overlap counts
    of one size pair are cut into chunks that separate tasks sum. Overlaps so far from the expected one that
    Chernoff's bounds put their chance below ``exp(-NIL)``, which is zero in doubles, are not listed: about the
    square root of the expected overlap is left.
    """
    sizes_a = _margins(cells, "target", by).groupBy(*by, F.col("c").alias("a")).agg(F.count(F.lit(1)).alias("times_a"))
    sizes_b = _margins(cells, "pred", by).groupBy(*by, F.col("c").alias("b")).agg(F.count(F.lit(1)).alias("times_b"))
    totals = cells.groupBy(*by).agg(F.sum("n_ij").alias("n"))
    a, b, n, m = F.col("a"), F.col("b"), F.col("n"), F.col("m")
    mean = a.cast("double") * b.cast("double") / n
    below, above = F.sqrt(2 * NIL * mean), NIL / 3 + F.sqrt(NIL * NIL / 9 + 2 * NIL * mean)
    low = F.greatest(F.lit(1).cast("long"), a + b - n, F.floor(mean - below).cast("long"))
    high = F.least(a, b, F.ceil(mean + above).cast("long"))
    # every size meets every other: both sides are laid out on a grid of cells, so that no task or broadcast holds all of one side
    most = sizes_a.select(*by).unionByName(sizes_b.select(*by)).groupBy(*by).count().agg(F.max("count")).first()[0] or 1
    grid = math.ceil(most / EMI_SIZES)
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(grid)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    rows = sizes_a.join(totals, list(by)).withColumn("_x", cell("a")).withColumn("_y", every)
    columns = sizes_b.withColumn("_y", cell("b")).withColumn("_x", every)
    chunks = (
        rows.join(columns, [*by, "_x", "_y"])
        .where(low <= high)
        .withColumn("start", F.explode(F.sequence(low, high, F.lit(EMI_CHUNK).cast("long"))))
        .repartition(cells.sparkSession.sparkContext.defaultParallelism, "a", "b", "start")  # few bytes, much work: not to be coalesced
    )
    terms = chunks.withColumn("m", F.explode(F.sequence("start", F.least(F.col("start") + EMI_CHUNK - 1, high))))
    term = (m / n) * (F.log(n.cast("double")) + F.log(m.cast("double")) - F.log(a.cast("double")) - F.log(b.cast("double")))
    weight = (F.col("times_a") * F.col("times_b")).cast("double")
    return terms.groupBy(*by).agg(F.sum(weight * term * F.exp(ln_overlap_chance(m, a, b, n))).alias("emi"))


def mutual_info_column() -> Column:
    n = F.col("n")
    return F.log(n) + (F.col("l_ij") - F.col("l_a") - F.col("l_b")) / n


def adjusted_mutual_info(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mutual information above chance, over the mean entropy above chance (natural logs)."""
    return _ami(contingency(labels, by), by).select(*by, "mi", "emi", "ami")


def _ami(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    keys = list(by) or ["_all"]
    if not by:
        cells = cells.withColumn("_all", F.lit(0))
    joined = pair_sums(cells, keys).join(expected_mutual_info(cells, keys), keys)
    n = F.col("n")
    mean_h = F.log(n) - (F.col("l_a") + F.col("l_b")) / (2 * n)
    mi = F.greatest(mutual_info_column(), F.lit(0.0))
    trivial = ((F.col("n_targets") == 1) & (F.col("n_preds") == 1)) | (
        (F.col("n_targets") == n) & (F.col("n_preds") == n)
    )
    value = _or_null(mi - F.col("emi"), mean_h - F.col("emi"))
    return joined.withColumns({"mi": mi, "ami": F.when(trivial, F.lit(1.0)).otherwise(value)})


def flat_scores(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """FM, Rand, ARI and AMI from one pass over the labels."""
    return _ami(contingency(labels, by), by).select(
        *by,
        fm_column().alias("fm"),
        rand_column().alias("rand"),
        adjusted_rand_column().alias("ari"),
        "ami",
    )

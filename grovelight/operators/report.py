"""Reports over score tables: medians, means, ranks, pivots, comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.ordering import exact_quantiles, value_ranks


def numeric_columns(df: DataFrame, besides: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in besides]


def median_by(df: DataFrame, keys: Sequence[str], metrics: Sequence[str] | None = None) -> DataFrame:
    """Median of each metric per group (nulls left out), from global ranks: a group may be of any size. Null keys form groups too."""
    metrics = list(metrics or numeric_columns(df, keys))
    grouped = df.withColumn("_group", F.struct(*keys)).select("_group", *[F.col(c).cast("double").alias(c) for c in metrics])
    found = exact_quantiles(grouped.unpivot(["_group"], metrics, "_metric", "_value"), "_value", [0.5], ["_group", "_metric"])
    wide = found.groupBy("_group").agg(*[F.max(F.when(F.col("_metric") == c, F.col("q0"))).alias(c) for c in metrics])
    return grouped.select("_group").distinct().join(wide, "_group", "left").select(*[F.col(f"_group.{k}").alias(k) for k in keys], *metrics)


def mean_by(df: DataFrame, keys: Sequence[str], metrics: Sequence[str] | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in metrics or numeric_columns(df, keys)])


def two_stage_median(
    df: DataFrame, inner: Sequence[str], outer: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """Median per inner key, then the median of those, so that no inner group weighs more."""
    return median_by(median_by(df, inner, metrics), outer, metrics)


def rank_methods(
    df: DataFrame, metrics: Sequence[str] = ("ari", "ami", "fm"),
    parts: Sequence[str] = ("reduction_method", "cluster_method"),
) -> DataFrame:
    """Descending tie-averaged rank per metric. One row per method; each metric is ranked apart."""
    labelled = df.withColumn("label", F.concat_ws(" + ", *parts))
    long = labelled.unpivot(["label"], list(metrics), "metric", "value")
    rising = value_ranks(long, "value", by=["metric"])
    all_of = rising.groupBy("metric").agg(F.sum("n").alias("_all"))
    falling = rising.join(all_of, "metric").select("metric", "value", (F.col("_all") + 1 - F.col("rank")).alias("r"))
    ranked = long.join(falling, ["metric", "value"]).select("label", "metric", "r")
    wide = ranked.groupBy("label").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("r"))).alias(f"rank_{m}") for m in metrics]
    )
    return labelled.join(wide, "label", "left")


def top_k(df: DataFrame, by: str = "dendrogram_purity", k: int = 8, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(by), *ties).limit(k)


def sort_scores(df: DataFrame, descending: Sequence[str] = ("ari", "ami"), then: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in descending], *then)


def pivot_wide(
    df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], metrics: Sequence[str], digits: int = 4
) -> DataFrame:
    """One column per (value, metric), means rounded; ``values`` names the columns, so no extra scan."""
    return df.groupBy(*rows).agg(
        *[
            F.round(F.avg(F.when(F.col(column) == v, F.col(m))), digits).alias(f"{v}_{m}")
            for v in values
            for m in metrics
        ]
    )


def mean_pm_std(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``mean ± sample deviation`` as text, four decimals."""
    return df.groupBy(*keys).agg(
        *[F.format_string("%.4f ± %.4f", F.avg(m), F.stddev_samp(m)).alias(m) for m in metrics]
    )


def side_by_side(a: DataFrame, b: DataFrame, keys: Sequence[str], suffixes: tuple[str, str]) -> DataFrame:
    def tagged(df: DataFrame, suffix: str) -> DataFrame:
        return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c not in keys})

    return tagged(a, suffixes[0]).join(tagged(b, suffixes[1]), list(keys), "inner")


def summary_two_groups(
    first: DataFrame, second: DataFrame, key: str, metrics: Sequence[str], names: tuple[str, str]
) -> DataFrame:
    """Mean per method of two result families next to each other; methods of either side stay."""
    def means(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(*[F.avg(m).alias(f"{name}_{m}") for m in metrics])

    return means(first, names[0]).join(means(second, names[1]), [key], "full_outer")


def placeholder_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text that is not a number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def filter_methods(df: DataFrame, methods: Sequence[str], column: str = "reduction_method") -> DataFrame:
    return df.where(F.col(column).isin(list(methods)))


def filter_level(df: DataFrame, level: int) -> DataFrame:
    return df.where(F.col("level") == level)


def stack_results(tables: Mapping[str, DataFrame], drop: Sequence[str] = ()) -> DataFrame:
    """All tables with a ``dataset`` tag; unwanted columns may be absent in some of them."""
    stacked = None
    for name, df in tables.items():
        part = df.drop(*drop).withColumn("dataset", F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return stacked


def compare_pipelines(families: Mapping[str, DataFrame], metrics: Sequence[str]) -> DataFrame:
    """Overall mean of each result family, one labelled row per family."""
    rows = None
    for name, df in families.items():
        row = df.agg(*[F.avg(m).alias(m) for m in metrics]).withColumn("family", F.lit(name))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def mean_by_one_factor(df: DataFrame, factors: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Marginal means of every factor in one pass: ``(factor, value, metrics…)``."""
    sets = df.groupingSets([[F.col(f)] for f in factors], *[F.col(f) for f in factors])
    means = sets.agg(*[F.avg(m).alias(m) for m in metrics], F.grouping_id().alias("_g"))
    shown = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    width = len(factors)
    for i, factor in enumerate(factors):
        only = ((1 << width) - 1) ^ (1 << (width - 1 - i))
        shown = F.when(F.col("_g") == only, F.lit(factor)).otherwise(shown)
        value = F.when(F.col("_g") == only, F.col(factor).cast("string")).otherwise(value)
    return means.select(shown.alias("factor"), value.alias("value"), *metrics)

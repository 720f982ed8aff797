"""Row preparation: cleaning, sampling, ids, label levels, run plans."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.ordering import with_position
from ..sources.scratch import Scratch

def union_splits(*splits: DataFrame) -> DataFrame:
    whole = splits[0]
    for split in splits[1:]:
        whole = whole.unionByName(split)
    return whole


def drop_all_duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Drop every copy of a repeated key, the first one too; one key after the other.

    Copies collapse in the map-side aggregation, so a key that holds a third of the rows sends one
    row per task over the network.
    """
    columns = df.columns
    for key in keys:
        rest = [c for c in columns if c != key]
        df = (
            df.groupBy(key)
            .agg(F.count(F.lit(1)).alias("_copies"), F.first(F.struct(*rest) if rest else F.lit(1)).alias("_row"))
            .where("_copies = 1")
        )
        df = df.select(key, "_row.*") if rest else df.select(key)
    return df.select(*columns)


def to_canonical(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Keep and rename the mapped columns, all as strings."""
    return df.select(*[F.col(f"`{old}`").cast("string").alias(new) for old, new in names.items()])


def canonical_levels(df: DataFrame) -> DataFrame:
    """``category 0`` -> ``category_0`` on every level column."""
    return df.withColumnsRenamed({c: c.replace(" ", "_") for c in df.columns if c.startswith("category ")})


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(subset) if subset else None)


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~tx.is_blank(F.col(column)))


def first_two_labels(df: DataFrame, labels: str) -> DataFrame:
    """Rows with at least two labels; the first two become the levels."""
    array = F.col(labels)
    return df.where(F.size(array) >= 2).withColumns(
        {"category_0": F.element_at(array, 1), "category_1": F.element_at(array, 2)}
    )


def split_categories(df: DataFrame, column: str) -> DataFrame:
    level_0, level_1 = tx.category_parts(F.col(column))
    return df.withColumns({"category_0": level_0, "category_1": level_1}).where(F.col("category_0").isNotNull())


def seed_key(seed: int, *ids: str | Column) -> Column:
    """A repeatable pseudo-random key of a row."""
    cols = [F.col(c) if isinstance(c, str) else c for c in ids]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols], F.lit(str(seed))))


def sample_n(df: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """At most n rows without replacement, the same for the same seed."""
    near = below_share(df, seed_key(seed, id_col), n)
    key = F.struct(seed_key(seed, id_col), F.col(id_col))
    return with_position(near, key, "_pos").where(F.col("_pos") < n).drop("_pos")


def hashed(*parts: Column) -> Column:
    """A 60-bit number from the columns' text, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def below_share(df: DataFrame, key: Column, n: int) -> DataFrame:
    """Rows whose md5 ``key`` is among the smallest, a little more than ``n`` of them, found without sorting.

    Should the hash leave fewer than ``n``, the share is doubled until it does not, or all rows are in.
    """
    rows = df.count()
    share = (n + 6 * math.sqrt(n) + 20) / max(rows, 1)
    while share < 1:
        near = df.where(key < f"{int(share * 16**8):08x}")
        if near.count() >= n:
            return near
        share *= 2
    return df


def full_depth_rows(df: DataFrame, depth: int) -> DataFrame:
    deepest = F.col(f"category_{depth - 1}")
    return df.where(deepest.isNotNull() & F.col("topic").isNotNull() & (F.col("topic") != deepest))


def seeded_permutation(df: DataFrame, seed: int, id_col: str = "id") -> DataFrame:
    """Shuffle: the new id is the position in a seeded order; whole rows move together."""
    key = F.struct(seed_key(seed, id_col), F.col(id_col))
    return with_position(df, key, "new_id")


def dense_ids(df: DataFrame, id_col: str = "id", out: str = "leaf") -> DataFrame:
    return with_position(df, F.col(id_col), out)


def encode_labels(df: DataFrame, column: str, fallback: str, palette: int) -> DataFrame:
    """0-based index of the sorted distinct labels, and that index modulo the palette size."""
    label = F.coalesce(F.nullif(F.col(column), F.lit("")), F.col(fallback))
    labelled = df.withColumn("label", label)
    codes = with_position(labelled.select("label").where("label IS NOT NULL").distinct(), F.col("label"), "label_idx")
    return labelled.join(codes, "label", "left").withColumn("colour_idx", F.pmod("label_idx", F.lit(palette)))


def _levels(depth: int) -> list[str]:
    return [f"category_{i}" for i in range(depth)]


def corpus_statistics(df: DataFrame, depth: int) -> DataFrame:
    """Rows and distinct labels per level, one row per measure."""
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.countDistinct(c).alias(c) for c in _levels(depth)]
    )
    return wide.unpivot([], ["rows", *_levels(depth)], "measure", "value")


def token_statistics(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    tokens = tx.token_count(F.col(column))
    return df.groupBy(*by).agg(
        F.sum(tokens).alias("total_tokens"),
        F.avg(tokens).alias("mean_tokens"),
        F.max(tokens).cast("long").alias("max_tokens"),
    )


def flatten_hierarchy(df: DataFrame, json_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Nested objects -> one row per node: ``(*keep, topic, path)``, the path holding its ancestors and itself.

    Each step opens one level of what is left, until no object is left, however deep.
    """
    scratch = Scratch(df.sparkSession)
    level = scratch.cut(df.select(*keep, F.array().cast("array<string>").alias("path"), F.col(json_col).alias("rest")), "roots")
    while not level.isEmpty():
        children = F.map_entries(F.from_json("rest", "map<string,string>"))
        level = scratch.cut(
            level.select(*keep, "path", F.explode(children).alias("e")).select(
                *keep, F.concat("path", F.array("e.key")).alias("path"), F.col("e.value").alias("rest")
            ),
            "levels",
        )
    return scratch.all_of("levels").select(*keep, F.element_at("path", -1).alias("topic"), "path") if scratch.has("levels") else level.select(
        *keep, F.lit(None).cast("string").alias("topic"), "path"
    )


def path_columns(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """``path`` as ``category_0 …``; without ``depth``, as many as the deepest path needs."""
    if depth is None:
        depth = nodes.agg(F.max(F.size("path"))).first()[0] or 0
    return nodes.withColumns({f"category_{i}": F.get("path", F.lit(i)) for i in range(depth)}).drop("path")


def add_noise_rows(df: DataFrame, fraction: float, k: int, seed: int) -> DataFrame:
    """Append ``int(fraction * n)`` rows whose topic joins k distinct sampled topics; labels null.

    A noise row picks k positions in the list of distinct topics: a start and k - 1 gaps that cannot
    run round the list, so the k topics differ.
    """
    spark = df.sparkSession
    # in the order of a digest: whole texts are no keys to sort by
    topics = with_position(df.select("topic").where("topic IS NOT NULL").distinct(), F.struct(F.md5("topic"), F.xxhash64("topic")), "pos")
    sizes = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("topic").alias("m")).first()
    m = max(sizes["m"], 1)
    take = min(k, m)
    draw = lambda tag, below: F.pmod(hashed(F.col("noise"), F.lit(f"{tag}:{seed}")), F.lit(below))
    offsets = [draw("start", m)]
    for i in range(1, take):
        offsets.append(offsets[-1] + 1 + draw(f"gap{i}", max(m // take, 1)))
    picks = spark.range(int(fraction * sizes["n"])).withColumnRenamed("id", "noise").select(
        "noise",
        F.posexplode(F.array(*[F.pmod(o, F.lit(m)) for o in offsets])).alias("nth", "pos"),
    )
    noise = (
        picks.join(topics, "pos")
        .groupBy("noise")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "topic"))), lambda p: p["topic"]), ", ").alias("topic"))
        .drop("noise")
    )
    return df.unionByName(noise, allowMissingColumns=True)


def levels_for(df: DataFrame, depth: int) -> DataFrame:
    """Clusters to ask for at each label level: its distinct labels, a null counting as one."""
    wide = df.agg(
        *[
            (F.countDistinct(c) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))).cast("long").alias(c)
            for c in _levels(depth)
        ]
    )
    long = wide.unpivot([], _levels(depth), "category", "n_clusters")
    return long.withColumn("level_idx", F.regexp_extract("category", r"(\d+)$", 1).cast("int")).orderBy(
        F.desc("level_idx")
    )


def closest_level(requested: DataFrame, available: DataFrame) -> DataFrame:
    """For each ``k``: the label level with the nearest count ``n_clusters``, the lower count on ties.

    ``available`` has one row per label level of the corpus, a handful by definition.
    """
    options = available.agg(F.collect_list(F.struct("n_clusters", "level_idx")).alias("o"))
    nearest = F.array_min(
        F.transform(
            "options",
            lambda o: F.struct(F.abs(F.col("k") - o["n_clusters"]).alias("gap"), o["n_clusters"].alias("n"), o["level_idx"].alias("l")),
        )
    )
    return (
        requested.withColumn("options", options.scalar())
        .withColumn("best", nearest)
        .select("k", F.col("best.n").alias("closest"), F.col("best.l").alias("level_idx"))
    )


# The parameter grids of the sweep.
PARAMETER_GRIDS = {
    "UMAP": [
        {"n_components": c, "n_neighbors": n, "min_dist": d}
        for c in (50, 100, 300)
        for n in (5, 15, 30)
        for d in (0.01, 0.1, 0.5)
    ],
    "PHATE": [{"n_components": c, "decay": d} for c in (50, 100, 300) for d in (10, 20, 40)],
    "PCA": [{"n_components": c} for c in (50, 100, 300)],
    "PaCMAP": [{"n_components": c} for c in (50, 100, 300)],
    "tSNE": [{"n_components": 2}],
}
CLUSTERERS = ("Agglomerative", "HDBSCAN")


def run_plan(
    models: DataFrame,
    grids: Mapping[str, Sequence[Mapping[str, object]]] | None = None,
    clusterers: Sequence[str] = CLUSTERERS,
) -> DataFrame:
    """All combinations of model, reduction setting and clusterer, with a short key per setting."""
    settings = F.array(
        *[
            F.struct(F.lit(method).alias("m"), F.lit(json.dumps(params, sort_keys=True)).alias("p"))
            for method, grid in (grids or PARAMETER_GRIDS).items()
            for params in grid
        ]
    )
    return (
        models.select("embedding_model")
        .withColumn("s", F.explode(settings))
        .withColumn("cluster_method", F.explode(F.array(*[F.lit(c) for c in clusterers])))
        .select(
            "embedding_model",
            F.col("s.m").alias("reduction_method"),
            F.col("s.p").alias("reduction_params"),
            F.substring(F.md5("s.p"), 1, 8).alias("params_key"),
            "cluster_method",
        )
    )

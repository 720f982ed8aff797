"""Scoring a cluster tree against all label levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import flat_scores as fs, trees as tr, tree_scores as ts
from ..operators.prep import levels_for


def flat_level_scores(merges: DataFrame, labels: DataFrame, depth: int, by_size: bool = False, index: tr.Indexed | None = None) -> DataFrame:
    """Cut the tree once per label level and score all cuts together: ``(level_idx, level, fm, rand, ari, ami)``.

    ``level`` is the number of clusters asked for; label levels with the same number stay apart by ``level_idx``.
    """
    index = index or tr.index_tree(tr.tree_from_merges(merges))
    return _level_scores(labels, depth, index, None if by_size else merges)


def _long(labels: DataFrame, depth: int, name: str) -> DataFrame:
    """One row for each id and label level."""
    return labels.unpivot(["id"], [f"category_{i}" for i in range(depth)], "category", name).select(
        "id", F.regexp_extract("category", r"(\d+)$", 1).cast("int").alias("level_idx"), name
    )


def _level_scores(labels: DataFrame, depth: int, index: tr.Indexed, merges: DataFrame | None) -> DataFrame:
    """Cuts by height where there are merges, else by size."""
    levels = levels_for(labels, depth).select("level_idx", F.col("n_clusters").alias("k"))
    asked = levels.select("k").distinct()
    cuts = tr.cut_by_size(index.nodes, asked, index) if merges is None else tr.cut_by_height(merges, asked, index)
    target = _long(labels, depth, "target").join(F.broadcast(levels), "level_idx")  # one row per label level
    pred = cuts.select("k", "id", F.col("cluster").alias("pred"))
    paired = index.scratch.cut(fs.aligned_labels(target, pred, on=("k", "id")), "paired")
    return fs.flat_scores(paired, ["level_idx", "k"]).withColumnRenamed("k", "level")


def score_levels(
    merges: DataFrame, labels: DataFrame, depth: int, model: str, reduction: str, clusterer: str, by_size: bool = False
) -> DataFrame:
    """One score row per label level: flat scores of the cut, exact tree scores of the whole tree."""
    return _scored(tr.tree_from_merges(merges), None if by_size else merges, labels, depth, model, reduction, clusterer)


def score_tree(tree: DataFrame, labels: DataFrame, depth: int, model: str, reduction: str, clusterer: str) -> DataFrame:
    """The same rows for a tree whose nodes may have any number of children: it is cut by splitting its largest clusters."""
    return _scored(tree, None, labels, depth, model, reduction, clusterer)


def _scored(
    tree: DataFrame, merges: DataFrame | None, labels: DataFrame, depth: int, model: str, reduction: str, clusterer: str
) -> DataFrame:
    index = tr.index_tree(tree)
    truth = index.scratch.cut(tr.ground_truth_tree(labels, depth), "truth")
    flat = index.scratch.cut(_level_scores(labels, depth, index, merges), "flat")
    apart = tr.clade_difference(index.nodes, truth, index).select("difference")
    whole = ts.level_scores(index, truth, _long(labels, depth, "label"))
    return flat.join(whole, "level_idx").withColumn("tree_difference", apart.scalar()).select(
        F.lit(model).alias("embedding_model"), F.lit(reduction).alias("reduction_method"), F.lit(clusterer).alias("cluster_method"),
        "level_idx", "level", "fm", "rand", "ari", "ami", "dendrogram_purity", "lca_f1", "tree_difference",
    )

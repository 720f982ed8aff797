"""Tree scores: dendrogram purity and LCA-F1, sampled and exact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.ordering import with_position, with_running_total
from ..sources.scratch import Scratch
from .prep import hashed
from .trees import Indexed, ancestors, count_below, fold_leaves, index_tree, lca, meeting_nodes


def _choose2(n):
    return n.cast("double") * (n - 1).cast("double") / 2


def sample_class_pairs(labels: DataFrame, m: int, seed: int) -> DataFrame:
    """``m`` uniform same-class pairs ``(pair, label, i, j)`` of ``labels(id, label)``, with repetition.

    A class is drawn with weight C(size, 2), then two distinct members by their position in it.
    """
    spark = labels.sparkSession
    scratch = Scratch(spark)
    known = scratch.cut(labels.where("label IS NOT NULL").select("id", "label"), "known")
    # pairs are counted in whole numbers wider than 64 bits: n * (n - 1) of a large class needs them
    pairs_of = F.expr("CAST(CAST(n AS DECIMAL(19, 0)) * CAST(n - 1 AS DECIMAL(19, 0)) / 2 AS DECIMAL(28, 0))")
    sizes = scratch.cut(known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    weighed = scratch.cut(
        with_running_total(sizes, F.col("label"), pairs_of, "start"), "weighed"
    )
    total = sizes.agg(F.sum(pairs_of).alias("t"))
    draw = lambda tag: hashed(F.col("pair"), F.lit(f"{tag}:{seed}"))
    share = draw("class").cast("decimal(19,0)") / F.lit(1 << 60).cast("decimal(19,0)")
    picks = spark.range(m).withColumnRenamed("id", "pair").withColumn("_total", total.scalar()).where("_total > 0")
    picks = picks.select("pair", F.floor(F.col("_total") * share).cast("decimal(38,0)").alias("u"), draw("a").alias("ra"), draw("b").alias("rb"))
    # the class of a draw: the last class that starts at or before it, by one shared order
    marks = weighed.select(F.col("start").cast("decimal(38,0)").alias("u"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("pair"), F.lit(1).alias("w"))
    spots = marks.unionByName(picks.select("u", F.lit(1).alias("kind"), "pair", F.lit(0).alias("w")))
    which = with_running_total(spots, F.struct("u", "kind", "pair"), F.col("w"), "c").where("kind = 1").select("pair", (F.col("c") - 1).alias("cls"))
    classes = with_position(weighed, F.col("start"), "cls")
    which, classes = scratch.cut(which, "which"), scratch.cut(classes, "classes")
    members = scratch.cut(with_position(known.join(sizes.select("label"), "label"), F.struct("label", "id"), "at"), "members")
    first = members.groupBy("label").agg(F.min("at").alias("first"))
    drawn = (
        picks.join(which, "pair").join(classes, "cls").join(first, "label")
        .withColumn("a", F.pmod("ra", "n"))
        .withColumn("b0", F.pmod("rb", F.col("n") - 1))
        .withColumn("b", F.col("b0") + F.when(F.col("b0") >= F.col("a"), 1).otherwise(0))
    )
    at = members.select("at", "id")
    return (
        drawn.withColumn("at", F.col("first") + F.col("a")).join(at.withColumnRenamed("id", "i"), "at").drop("at")
        .withColumn("at", F.col("first") + F.col("b")).join(at.withColumnRenamed("id", "j"), "at")
        .select("pair", "label", "i", "j")
    )


def _known(labels: DataFrame) -> DataFrame:
    return labels.where("label IS NOT NULL").select(F.col("label").alias("group"), F.col("id").alias("leaf"))


def dendrogram_purity_sampled(tree: DataFrame, labels: DataFrame, m: int = 1000, seed: int = 67, index: Indexed | None = None) -> DataFrame:
    """Mean share of the pair's class below the pair's lowest common ancestor."""
    index = index or index_tree(tree)
    pairs = index.scratch.cut(sample_class_pairs(labels, m, seed), "pairs")
    met = index.scratch.cut(lca(index, pairs).select("pair", F.col("label").alias("group"), F.col("anc").alias("node")), "met")
    counts = count_below(index, _known(labels), met.select("group", "node"))
    share = met.join(counts, ["group", "node"]).join(index.nodes.select("node", "size"), "node")
    return share.agg(F.avg(F.col("n") / F.col("size")).alias("dendrogram_purity"), F.count(F.lit(1)).alias("pairs"))


def dendrogram_purity(tree: DataFrame, labels: DataFrame, index: Indexed | None = None) -> DataFrame:
    """The mean over all same-class pairs.

    A node's pairs are those of its members that do not already meet further down, so the sum over
    pairs becomes a sum over meeting nodes of C(n, 2) times the share here minus the share above.
    """
    folded, members = None, _known(labels)
    if index is None:
        marks = members.select("leaf", F.lit(1).alias("copies"), "group")
        folded = fold_leaves(tree, marks, Scratch(tree.sparkSession))
    if folded:
        tree, members = folded
    index = index or index_tree(tree)
    met = index.scratch.cut(meeting_nodes(index, members, bool(folded)), "meet")
    return _mean(_purity_terms(index, met), "dendrogram_purity")


def _mean(terms: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Means over pairs from the terms ``(group, t, pairs)``."""
    return terms.groupBy(*by).agg(F.sum("t").alias("t"), F.sum("pairs").alias("pairs")).select(
        *by, F.when(F.col("pairs") > 0, F.col("t") / F.col("pairs")).alias(name)
    )


def _purity_terms(index: Indexed, met: DataFrame) -> DataFrame:
    share = met.join(index.nodes.select("node", "size"), "node").select("group", "node", "n", "above", (F.col("n") / F.col("size")).alias("p"))
    above = share.select("group", F.col("node").alias("above"), F.col("p").alias("p_above"))
    return share.join(above, ["group", "above"], "left").select(
        "group",
        (_choose2(F.col("n")) * (F.col("p") - F.coalesce("p_above", F.lit(0.0)))).alias("t"),
        F.when(F.col("above").isNull(), _choose2(F.col("n"))).otherwise(F.lit(0.0)).alias("pairs"),
    )


def lca_f1_sampled(
    pred: DataFrame, truth: DataFrame, labels: DataFrame, m: int = 1000, seed: int = 67, pred_index: Indexed | None = None
) -> DataFrame:
    """Mean F1 of the leaf sets below the pair's lowest common ancestors in both trees."""
    pi, ti = pred_index or index_tree(pred), index_tree(truth)
    pairs = pi.scratch.cut(sample_class_pairs(labels, m, seed), "pairs")
    in_pred = lca(pi, pairs).select("pair", F.col("anc").alias("u"), "i", "j")
    met = pi.scratch.cut(lca(ti, in_pred).select("pair", "u", F.col("anc").alias("w")), "met")
    common = count_below(pi, _under_truth(truth), met.select(F.col("w").alias("group"), F.col("u").alias("node")))
    f1 = (
        met.join(common.select(F.col("group").alias("w"), F.col("node").alias("u"), "n"), ["w", "u"])
        .join(pi.nodes.select(F.col("node").alias("u"), F.col("size").alias("nu")), "u")
        .join(ti.nodes.select(F.col("node").alias("w"), F.col("size").alias("nw")), "w")
    )
    return f1.agg(F.avg(2 * F.col("n") / (F.col("nu") + F.col("nw"))).alias("lca_f1"), F.count(F.lit(1)).alias("pairs"))


def _under_truth(truth: DataFrame) -> DataFrame:
    """Every leaf with each truth node above it. Truth trees are as deep as the label hierarchy."""
    leaves = truth.where("is_leaf").select("node")
    up = ancestors(truth).where("steps > 0")
    return up.join(leaves, "node", "left_semi").select(F.col("anc").alias("group"), F.col("node").alias("leaf"))


def lca_f1(pred: DataFrame, truth: DataFrame, labels: DataFrame, pred_index: Indexed | None = None) -> DataFrame:
    """The mean over all same-class pairs whose leaves are in both trees.

    Pairs are grouped by class and truth node; below each truth node the pairs meet at nodes of the
    predicted tree as in ``dendrogram_purity``. A pair is counted once for every truth node above it,
    with the F1 there minus the F1 at the next truth node up, which telescopes to its own F1.
    """
    classes = labels.where("label IS NOT NULL").select(F.col("id").alias("leaf"), "label")
    folded = None
    if pred_index is None:
        in_truth = truth.groupBy(F.col("node").alias("leaf")).agg(
            F.count(F.lit(1)).alias("copies"), F.max("is_leaf").alias("is_leaf"), F.min("parent").alias("lowest")
        ).where("is_leaf").select("leaf", "copies", "lowest")
        folded = fold_leaves(pred, in_truth.join(classes, "leaf", "left"), Scratch(pred.sparkSession))
    if folded:
        pred, cells = folded
        index = index_tree(pred)
        truth = index.scratch.cut(truth.where("NOT is_leaf"), "truth")
        up = ancestors(truth).select(F.col("node").alias("lowest"), F.col("anc").alias("group"))
        under = index.scratch.cut(cells.join(up, "lowest").select("group", "leaf", "times", "label"), "under")
        members = under.where("label IS NOT NULL").select(F.struct("label", F.col("group").alias("w")).alias("group"), "leaf", "times")
    else:
        index = pred_index or index_tree(pred)
        under = index.scratch.cut(_under_truth(truth), "under")
        members = under.join(classes, "leaf").select(F.struct("label", F.col("group").alias("w")).alias("group"), "leaf")
    met = index.scratch.cut(meeting_nodes(index, members, bool(folded)), "meet")
    return _mean(_f1_terms(index, truth, under, met), "lca_f1")


def _f1_terms(index: Indexed, truth: DataFrame, under: DataFrame, met: DataFrame) -> DataFrame:
    """``met`` is grouped by class and truth node ``w``, ``under`` are the leaves of each truth node."""
    scratch = index.scratch
    met = met.select(
        "group", F.col("group.w").alias("w"), F.col("node").alias("u"), "n", "above"
    )
    truth_up = truth.select(F.col("node").alias("w"), F.col("parent").alias("w_up"))
    at_w = met.select("w", "u")
    at_up = at_w.distinct().join(truth_up, "w").where("w_up IS NOT NULL").select(F.col("w_up").alias("w"), "u")
    wanted = at_w.unionByName(at_up).distinct().select(F.col("w").alias("group"), F.col("u").alias("node"))
    common = scratch.cut(count_below(index, under, wanted), "common")
    f1 = (
        common.select(F.col("group").alias("w"), F.col("node").alias("u"), F.col("n").alias("both"))
        .join(index.nodes.select(F.col("node").alias("u"), F.col("size").alias("nu")), "u")
        .join(truth.select(F.col("node").alias("w"), F.col("size").alias("nw")), "w")
        .select("w", "u", (2 * F.col("both") / (F.col("nu") + F.col("nw"))).alias("f1"))
    )
    f1 = scratch.cut(f1, "f1")
    up_f1 = f1.select(F.col("w").alias("w_up"), "u", F.col("f1").alias("f1_up"))
    gain = met.join(f1, ["w", "u"]).join(truth_up, "w").join(up_f1, ["w_up", "u"], "left").select(
        "group", "u", "n", "above", "w_up", (F.col("f1") - F.coalesce("f1_up", F.lit(0.0))).alias("g")
    )
    gain = scratch.cut(gain, "gain")
    above = gain.select("group", F.col("u").alias("above"), F.col("g").alias("g_above"))
    terms = gain.join(above, ["group", "above"], "left")
    return terms.select(
        "group",
        (_choose2(F.col("n")) * (F.col("g") - F.coalesce("g_above", F.lit(0.0)))).alias("t"),
        F.when(F.col("above").isNull() & F.col("w_up").isNull(), _choose2(F.col("n"))).otherwise(F.lit(0.0)).alias("pairs"),
    )


def level_scores(index: Indexed, truth: DataFrame, labels: DataFrame) -> DataFrame:
    """``dendrogram_purity`` and ``lca_f1`` of every level of ``labels(level_idx, id, label)``, all from the same meeting nodes."""
    scratch = index.scratch
    ids = labels.select(F.col("level_idx").alias("of"), "id")
    for number, nodes in enumerate((index.nodes, truth), start=1):
        ids = ids.unionByName(nodes.select(F.lit(-number).alias("of"), F.col("node").alias("id")))
    once = ids.groupBy("of", "id").count().where("count > 1").isEmpty()
    known = labels.where("label IS NOT NULL").select("level_idx", "label", F.col("id").alias("leaf"))
    under = scratch.cut(_under_truth(truth), "under")
    group = lambda alone, w: F.struct("level_idx", "label", F.lit(alone).alias("alone"), w.cast("long").alias("w")).alias("group")
    members = known.select(group(True, F.lit(0)), "leaf").unionByName(
        under.withColumnRenamed("group", "_w").join(known, "leaf").select(group(False, F.col("_w")), "leaf")
    )
    met = scratch.cut(meeting_nodes(index, members, once), "meet")
    level = F.col("group.level_idx").alias("level_idx")
    purity = _purity_terms(index, met.where("group.alone")).select(level, "t", "pairs")
    f1 = _f1_terms(index, truth, under, met.where("NOT group.alone")).select(level, "t", "pairs")
    found = labels.select("level_idx").distinct().join(_mean(purity, "dendrogram_purity", ["level_idx"]), "level_idx", "left")
    return found.join(_mean(f1, "lca_f1", ["level_idx"]), "level_idx", "left")

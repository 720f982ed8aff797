"""Trees as tables.

A tree is ``(node, parent, size, is_leaf)``: the root's parent is null and ``size`` counts leaves. A
merge table is ``(node, left, right, height, size)``. Trees may be chains as deep as they are large,
so nothing here walks one level per job: parents are doubled (``log2`` of the depth rounds), subtrees
are intervals of leaf positions, and sums over subtrees are differences of running totals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import with_position, with_running_total, with_running_totals
from ..sources.scratch import Scratch
from .graph import roots


def ground_truth_tree(df: DataFrame, depth: int, id_col: str = "id") -> DataFrame:
    """Tree of label paths over rows with leaf ids ``0..n-1``.

    Every distinct full path is a node. A shorter prefix is a node when it has more than one child
    prefix; the empty prefix (the root) follows the same rule. Extra columns: ``level`` (length of
    the prefix, null for leaves).
    """
    levels = F.array(*[F.col(f"category_{i}").cast("string") for i in range(depth)])
    rows = df.select(F.col(id_col).alias("leaf"), levels.alias("path"))
    paths = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size"))
    prefixes = paths.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    inner = (
        prefixes.groupBy("level", F.expr("slice(path, 1, level)").alias("prefix"))
        .agg(F.countDistinct(F.expr("slice(path, 1, level + 1)")).alias("kids"), F.sum("size").alias("size"))
        .where("kids > 1")
        .select("level", "prefix", "size")
    )
    nodes = inner.unionByName(paths.select(F.lit(depth).alias("level"), F.col("path").alias("prefix"), "size"))
    placed = with_position(nodes, F.struct((-F.col("level")).alias("up"), F.col("prefix")), "pos")
    n = df.agg(F.count(F.lit(1)))
    named = placed.withColumn("node", F.col("pos") + n.scalar()).drop("pos")
    above = named.where("level > 0").select("node", F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("level"), F.col("prefix").alias("own"))
    above = above.withColumn("prefix", F.expr("slice(own, 1, level)"))
    parents = above.join(named.select("level", "prefix", F.col("node").alias("up")), ["level", "prefix"]).groupBy("node").agg(
        F.max_by("up", "level").alias("parent")
    )
    internal = named.join(parents, "node", "left").select("node", "parent", "size", F.lit(False).alias("is_leaf"), "level")
    leaves = rows.join(named.where(F.col("level") == depth).select(F.col("prefix").alias("path"), F.col("node").alias("parent")), "path").select(
        F.col("leaf").alias("node"), "parent", F.lit(1).cast("long").alias("size"), F.lit(True).alias("is_leaf"),
        F.lit(None).cast("int").alias("level"),
    )
    return internal.unionByName(leaves)


def tree_from_merges(merges: DataFrame, root_only: bool = True) -> DataFrame:
    """Merge table -> tree. When merging stopped early only the last merge's subtree is kept."""
    links = merges.select(F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("parent"))
    made = merges.select("node", F.col("size").cast("long").alias("size"), F.lit(False).alias("is_leaf"))
    tree = made.join(links, "node", "full_outer").select(
        "node", "parent", F.coalesce("size", F.lit(1)).cast("long").alias("size"), F.coalesce("is_leaf", F.lit(True)).alias("is_leaf")
    )
    if not root_only or tree.where("parent IS NULL").count() <= 1:
        return tree
    scratch = Scratch(merges.sparkSession)
    tree = scratch.cut(tree, "tree")
    top = roots(scratch, tree.select(F.col("node").alias("comp"), F.coalesce("parent", "node").alias("parent")))
    last = merges.agg(F.max("node"))
    inside = top.where(F.col("root") == last.scalar()).select(F.col("comp").alias("node"))
    return tree.join(inside, "node", "left_semi")


def subtree_sums(tree: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(node, parent, w)`` -> ``(node, total)``: the sum of ``w`` over a node and all below it.

    After round r a node holds the sum over descendants fewer than ``2**r`` steps down; adding the
    sums of the nodes exactly ``2**r`` steps down doubles the reach.
    """
    scratch = scratch or Scratch(tree.sparkSession)
    state = scratch.cut(tree.select("node", F.col("parent").alias("up"), F.col("w").alias("total")), "sums", keep=2)
    while not state.where("up IS NOT NULL").isEmpty():
        below = state.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("total").alias("more"))
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"))
        stepped = state.join(above, "up", "left").join(below, "node", "left").select(
            "node", F.col("next").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")
        )
        state = scratch.cut(stepped, "sums", keep=2)
    return state.select("node", "total")


def with_sizes(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Merge rows ``(node, left, right, height)`` -> a merge table with leaf counts."""
    tree = links.select(F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("parent"))
    all_nodes = tree.join(links.select("node", F.lit(0).cast("long").alias("inner")), "node", "full_outer")
    weighed = all_nodes.select("node", "parent", F.coalesce("inner", F.lit(1)).cast("long").alias("w"))
    sums = subtree_sums(weighed, scratch)
    return links.join(sums, "node").select("node", "left", "right", "height", F.col("total").alias("size"))


def children_lists(tree: DataFrame) -> DataFrame:
    """The ordered children of every node as rows ``(node, position, child)``, from 0; a leaf has one row without a child.

    Positions come from one global order, so a node may have any number of children.
    """
    edges = tree.where("parent IS NOT NULL").select(F.col("parent").alias("node"), F.col("node").alias("child"))
    placed = with_position(edges, F.struct("node", "child"), "_at")
    first = placed.groupBy("node").agg(F.min("_at").alias("_first"))
    lists = placed.join(first, "node").select("node", (F.col("_at") - F.col("_first")).alias("position"), "child")
    return tree.select("node").join(lists, "node", "left").select("node", "position", "child")


def ancestors(tree: DataFrame) -> DataFrame:
    """``(node, anc, steps)`` for every ancestor, the node itself included, by doubling."""
    scratch = Scratch(tree.sparkSession)
    parents = tree.select("node", "parent")
    known = parents.select("node", F.col("node").alias("anc"), F.lit(0).alias("steps")).unionByName(
        parents.where("parent IS NOT NULL").select("node", F.col("parent").alias("anc"), F.lit(1).alias("steps"))
    )
    known = scratch.cut(known, "known", keep=2)
    reach = 1
    while True:
        frontier = known.where(F.col("steps") == reach)
        if frontier.isEmpty():
            return known
        step = known.where("steps > 0").select(F.col("node").alias("anc"), F.col("anc").alias("far"), F.col("steps").alias("more"))
        found = frontier.join(step, "anc").select("node", F.col("far").alias("anc"), (F.col("steps") + F.col("more")).alias("steps"))
        known = scratch.cut(known.unionByName(found), "known", keep=2)
        reach *= 2


def leaves_under(tree: DataFrame) -> DataFrame:
    """``(node, leaf)`` for every node and every leaf below it (a leaf is below itself)."""
    index = index_tree(tree)
    at = index.nodes.select("node", F.explode(F.sequence("lo", "hi")).alias("at"))
    return at.join(index.nodes.where("is_leaf").select(F.col("lo").alias("at"), F.col("node").alias("leaf")), "at").select("node", "leaf")


def depths(tree: DataFrame) -> DataFrame:
    """``(node, depth)``: steps to the root, by doubling pointers that carry how far they reach."""
    scratch = Scratch(tree.sparkSession)
    state = scratch.cut(tree.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")), "depths", keep=2)
    while not state.where("up IS NOT NULL").isEmpty():
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = scratch.cut(
            state.join(above, "up", "left").select("node", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")),
            "depths", keep=2,
        )
    return state.select("node", "depth")


def tree_summary(tree: DataFrame) -> DataFrame:
    """Per depth: nodes, and mean, least and most children; leaves below the root do not count."""
    up = depths(tree)
    kids = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    counted = up.join(kids, "node", "left").where("depth = 0 OR kids IS NOT NULL").withColumn("kids", F.coalesce("kids", F.lit(0)))
    return counted.groupBy("depth").agg(
        F.count(F.lit(1)).alias("nodes"), F.avg("kids").alias("mean_children"),
        F.min("kids").alias("min_children"), F.max("kids").alias("max_children"),
    )


@dataclass
class Indexed:
    """A tree with leaf-position intervals: ``nodes`` is ``(node, parent, size, is_leaf, lo, hi)`` and
    ``jumps[k]`` is ``(node, up, lo, hi)``, the ancestor ``2**k`` steps up and its interval."""

    nodes: DataFrame
    jumps: list[DataFrame]
    scratch: Scratch


def index_tree(tree: DataFrame) -> Indexed:
    """Give every node the interval of leaf positions below it."""
    scratch = Scratch(tree.sparkSession)
    tree = scratch.cut(tree.select("node", "parent", "size", "is_leaf"), "tree")
    child = tree.where("parent IS NOT NULL")
    placed = with_running_total(child, F.struct("parent", "node"), F.col("size"), "_at")
    first = placed.groupBy("parent").agg(F.min("_at").alias("_first"))
    earlier = placed.join(first, "parent").select("node", "parent", (F.col("_at") - F.col("_first")).alias("acc"))
    state = scratch.cut(earlier.select("node", F.col("parent").alias("up"), "acc"), "jump")
    steps = [state]
    while True:
        above = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("acc").alias("_acc"))
        moved = state.join(above, "up", "left").select(
            "node", F.col("_up").alias("up"), (F.col("acc") + F.coalesce("_acc", F.lit(0))).alias("acc")
        )
        state = scratch.cut(moved, "jump")
        if state.where("up IS NOT NULL").isEmpty():
            break
        steps.append(state)
    start = state.select("node", F.col("acc").alias("lo"))
    nodes = tree.join(start, "node", "left").withColumn("lo", F.coalesce("lo", F.lit(0)).cast("long"))
    nodes = scratch.cut(nodes.withColumn("hi", F.col("lo") + F.col("size") - 1), "nodes")
    ends = nodes.select(F.col("node").alias("up"), "lo", "hi")
    jumps = [step.where("up IS NOT NULL").select("node", "up").join(ends, "up") for step in steps]
    return Indexed(nodes, jumps, scratch)


def tree_intervals(tree: DataFrame) -> DataFrame:
    return index_tree(tree).nodes


def lca(index: Indexed, pairs: DataFrame) -> DataFrame:
    """Add ``anc``, the lowest common ancestor of the leaves ``i`` and ``j``; pairs with a leaf
    outside the tree drop out. From ``i`` climb by halving jumps while ``j`` is still outside."""
    place = index.nodes.select("node", "lo")
    state = (
        pairs.join(place.select(F.col("node").alias("j"), F.col("lo").alias("_pj")), "j")
        .join(place.select(F.col("node").alias("i"), F.col("lo").alias("_pi")), "i")
        .withColumn("_at", F.col("i"))
    )
    outside = ~F.col("_pj").between(F.col("_lo"), F.col("_hi"))
    for jump in reversed(index.jumps):
        step = jump.select(F.col("node").alias("_at"), F.col("up").alias("_up"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        state = state.join(step, "_at", "left").withColumn(
            "_at", F.when(F.col("_up").isNotNull() & outside, F.col("_up")).otherwise(F.col("_at"))
        ).drop("_up", "_lo", "_hi")
    up = index.nodes.select(F.col("node").alias("_at"), F.col("parent").alias("_parent"))
    return state.join(up, "_at").withColumn(
        "anc", F.when(F.col("_pi") == F.col("_pj"), F.col("i")).otherwise(F.col("_parent"))
    ).drop("_at", "_parent", "_pi", "_pj")


def _spots(index: Indexed, members: DataFrame, queries: DataFrame, times: Column) -> DataFrame:
    """Members and the interval ends of the asked nodes, one row each, written."""
    spots = members.join(index.nodes.select(F.col("node").alias("leaf"), F.col("lo").alias("pos")), "leaf").select(
        "group", "pos", F.lit(1).alias("kind"), F.col("leaf").alias("tag"), times.alias("w")
    )
    placed = queries.distinct().join(index.nodes.select("node", "lo", "hi"), "node")
    ends = placed.select(
        "group", F.explode(F.array(
            F.struct(F.col("lo").alias("pos"), F.lit(0).alias("kind")), F.struct(F.col("hi").alias("pos"), F.lit(2).alias("kind"))
        )).alias("e"), F.col("node").alias("tag"),
    ).select("group", "e.pos", "e.kind", "tag", F.lit(0).alias("w"))
    return index.scratch.cut(spots.unionByName(ends), "spots")


def _times(members: DataFrame) -> Column:
    return F.col("times") if "times" in members.columns else F.lit(1)


def count_below(index: Indexed, members: DataFrame, queries: DataFrame) -> DataFrame:
    """How many members of a group lie below a node: ``members(group, leaf)``, ``queries(group, node)``
    -> ``(group, node, n)``. Members and interval ends share one global order; a count is the
    difference of two running totals. With a column ``times`` a member stands for so many."""
    written = _spots(index, members, queries, _times(members))
    totals = with_running_total(written, F.struct("group", "pos", "kind", "tag"), F.col("w"), "before")
    return totals.where("kind <> 1").groupBy("group", F.col("tag").alias("node")).agg(
        (F.max("before") - F.min("before")).cast("long").alias("n")
    )


def _spans(index: Indexed, members: DataFrame, queries: DataFrame) -> DataFrame:
    """``count_below`` of members that are there once, with the global position ``first`` of the first of them and their ``rows``."""
    written = _spots(index, members, queries, _times(members))
    key, one = F.struct("group", "pos", "kind", "tag"), F.when(F.col("kind") == 1, 1).otherwise(0)
    totals = with_running_totals(written, key, {"before": F.col("w"), "row": one})
    return totals.where("kind <> 1").groupBy("group", F.col("tag").alias("node")).agg(
        (F.max("before") - F.min("before")).cast("long").alias("n"), F.min("row").cast("long").alias("first"),
        (F.max("row") - F.min("row")).cast("long").alias("rows"),
    )


def fold_leaves(tree: DataFrame, marks: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame] | None:
    """The tree with one leaf for all that have the same parent and the same marks, and these leaves ``(leaf, times, marks…)``.

    ``marks`` is ``(leaf, copies, …)``; leaves without marks are left out, sizes stay those of the whole tree. ``None`` where an id comes
    more than once or is not a leaf's: such rows do not stand for each other.
    """
    keys = [c for c in marks.columns if c not in ("leaf", "copies")]
    held = tree.select(F.col("node").alias("leaf"), F.col("parent").alias("_up"), "is_leaf").join(marks, "leaf").groupBy("leaf").agg(
        F.sum("copies").alias("copies"), F.min("is_leaf").alias("is_leaf"), *[F.min(c).alias(c) for c in ("_up", *keys)]
    )
    folded = scratch.cut(held.groupBy("_up", *keys).agg(
        F.count(F.lit(1)).alias("times"), F.min("leaf").alias("leaf"), F.max("copies").alias("copies"), F.min("is_leaf").alias("is_leaf")
    ), "folded")
    whole = folded.agg((F.max("copies") == 1) & F.min("is_leaf") & (F.count("_up") == F.count(F.lit(1)))).first()[0]
    if not whole:
        return None
    leaves = folded.select(F.col("leaf").alias("node"), F.col("_up").alias("parent"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("is_leaf"))
    inner = tree.where("NOT is_leaf").select("node", "parent", F.col("size").cast("long").alias("size"), "is_leaf")
    return inner.unionByName(leaves), folded.select("leaf", "times", *keys)


def meeting_nodes(index: Indexed, members: DataFrame, once: bool = False) -> DataFrame:
    """Where pairs of the same group meet: ``(group, node, n, above)``.

    Only the ancestors of leaves that are neighbours in their group's leaf order can be such nodes,
    so there are fewer of them than members. ``n`` counts the group's members below ``node`` and
    ``above`` is the next meeting node of the group on the way up (null at the top). With a column ``times`` a member
    stands for so many with the same parent, who meet there. ``once``: no id comes twice in a group or in the tree, so one order tells counts and positions.
    """
    scratch = index.scratch
    spots = members.join(index.nodes.select(F.col("node").alias("leaf"), F.col("lo").alias("pos")), "leaf")
    ordered = scratch.cut(with_position(spots, F.struct("group", "pos"), "at").select("group", "leaf", "at"), "ordered")
    following = ordered.select("group", (F.col("at") - 1).alias("at"), F.col("leaf").alias("j"))
    pairs = ordered.select("group", "at", F.col("leaf").alias("i")).join(following, ["group", "at"])
    met = scratch.cut(lca(index, pairs).select("group", "at", F.col("anc").alias("node")), "met")
    nodes = met.select("group", "node")
    if "times" in members.columns:
        shared = members.where("times > 1").join(index.nodes.select(F.col("node").alias("leaf"), F.col("parent").alias("node")), "leaf")
        nodes = nodes.unionByName(shared.select("group", "node"))
    nodes = nodes.distinct()
    if once:
        spans = _spans(index, members, nodes)
    else:
        counts = count_below(index, members, nodes)
        # the first member below a node: rows of the group before it are those left of the node's interval
        first = ordered.join(index.nodes.select(F.col("node").alias("leaf"), F.col("lo").alias("pos")), "leaf")
        spans = counts.join(_first_member(index, first, nodes), ["group", "node"]).withColumn("rows", F.col("n"))
    sizes = index.nodes.select("node", F.col("size").alias("_size"))
    met_sized = met.join(sizes, "node").select("group", "at", F.struct(F.col("_size"), F.col("node").alias("n")).alias("m"))
    left = met_sized.select("group", (F.col("at") + 1).alias("first"), F.col("m").alias("lm"))
    right = met_sized.select("group", F.col("at").alias("last"), F.col("m").alias("rm"))
    spans = spans.withColumn("last", F.col("first") + F.col("rows") - 1)
    both = spans.join(left, ["group", "first"], "left").join(right, ["group", "last"], "left")
    return both.select("group", "node", "n", F.least("lm", "rm")["n"].alias("above"))


def _first_member(index: Indexed, ordered: DataFrame, queries: DataFrame) -> DataFrame:
    """Global position ``first`` of the group's first member inside each node's interval."""
    spots = ordered.select("group", "pos", F.lit(1).alias("kind"), F.col("leaf").alias("tag"), F.lit(1).alias("w"))
    starts = queries.join(index.nodes.select("node", F.col("lo").alias("pos")), "node").select(
        "group", "pos", F.lit(0).alias("kind"), F.col("node").alias("tag"), F.lit(0).alias("w")
    )
    written = index.scratch.cut(spots.unionByName(starts), "starts")
    totals = with_running_total(written, F.struct("group", "pos", "kind", "tag"), F.col("w"), "before")
    return totals.where("kind = 0").select("group", F.col("tag").alias("node"), F.col("before").cast("long").alias("first"))


def _split_levels(index: Indexed, splits: DataFrame, levels: DataFrame) -> DataFrame:
    """Clusters after opening the nodes in ``splits(k, node)``: ``(k, id, cluster)``."""
    nodes = index.nodes.select("node", "parent", "lo", "is_leaf")
    wanted = levels.agg(F.collect_set("k").alias("ks"))  # one k per label level
    per_level = nodes.withColumn("k", F.explode(wanted.scalar()))
    opened = splits.select("k", "node", F.lit(True).alias("open"))
    above = splits.select("k", F.col("node").alias("parent"), F.lit(True).alias("open_above"))
    marked = per_level.join(opened, ["k", "node"], "left").join(above, ["k", "parent"], "left")
    starts = marked.where("open IS NULL AND (open_above OR parent IS NULL)").select(
        "k", F.col("lo").alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(1).alias("w")
    )
    leaves = per_level.where("is_leaf").select(
        "k", F.col("lo").alias("pos"), F.lit(1).alias("kind"), F.col("node").alias("id"), F.lit(0).alias("w")
    )
    written = index.scratch.cut(starts.unionByName(leaves), "cut")
    totals = with_running_total(written, F.struct("k", "pos", "kind"), F.col("w"), "c")
    first = totals.groupBy("k").agg(F.min("c").alias("_c"))
    return totals.where("kind = 1").join(first, "k").select("k", "id", (F.col("c") - F.col("_c")).cast("long").alias("cluster"))


def cut_by_height(merges: DataFrame, levels: DataFrame, index: Indexed | None = None) -> DataFrame:
    """Cut at the lowest height that leaves at most ``k`` clusters, for every ``k`` in ``levels``.

    Equal heights are never split, so fewer than ``k`` clusters can come out.
    """
    index = index or index_tree(tree_from_merges(merges))
    inside = merges.join(index.nodes.select("node"), "node", "left_semi")
    placed = with_position(inside.select("node", "height"), F.struct((-F.col("height")).alias("h"), F.col("node")), "pos")
    placed = index.scratch.cut(placed, "heights")
    limit = levels.select("k").distinct().join(placed.select((F.col("pos") + 1).alias("k"), F.col("height").alias("t")), "k", "left")
    limits = limit.agg(F.collect_list(F.struct("k", "t")).alias("l"))  # one per label level
    splits = placed.withColumn("l", F.explode(limits.scalar())).select("node", "height", "l.*").where(
        F.col("t").isNull() | (F.col("height") > F.col("t"))
    )
    return _split_levels(index, splits.select("k", "node"), levels)


def cut_by_size(tree: DataFrame, levels: DataFrame, index: Indexed | None = None) -> DataFrame:
    """Always the largest cluster is split into its children, until there are ``k`` clusters or, where nodes have several children, more."""
    index = index or index_tree(tree)
    inner = index.nodes.where("NOT is_leaf").select("node", "size")
    grown = index.nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg((F.count(F.lit(1)) - 1).alias("more"))
    placed = with_running_total(inner.join(grown, "node"), F.struct((-F.col("size")).alias("s"), F.col("node")), F.col("more"), "pos")
    placed = index.scratch.cut(placed.select("node", "pos"), "sizes")
    wanted = levels.agg(F.collect_set("k").alias("ks"))  # one k per label level
    splits = placed.withColumn("k", F.explode(wanted.scalar())).where(F.col("pos") < F.col("k") - 1)
    return _split_levels(index, splits.select("k", "node"), levels)


def clade_difference(tree_a: DataFrame, tree_b: DataFrame, index_a: Indexed | None = None) -> DataFrame:
    """Leaf sets that only one of the two trees has: ``(only_a, only_b, difference)``.

    A leaf set is known by its size and four sums of 60-bit leaf hashes, taken from running totals in decimals that can't overflow.
    """
    names = ["h1", "h2", "h3", "h4"]

    def clades(index: Indexed) -> DataFrame:
        hashes = [F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 60)).cast("decimal(38,0)").alias(seed) for seed in names]
        leaves = index.nodes.where("is_leaf").select("node", "lo", *hashes)
        sums = index.scratch.cut(with_running_totals(leaves, F.col("lo"), {f"{h}_before": F.col(h) for h in names}), "sums")
        inner = index.nodes.where("NOT is_leaf").select("lo", "hi", "size")
        start = sums.select("lo", *[F.col(f"{h}_before").alias(f"s_{h}") for h in names])
        end = sums.select(F.col("lo").alias("hi"), *[(F.col(f"{h}_before") + F.col(h)).alias(f"e_{h}") for h in names])
        return inner.join(start, "lo").join(end, "hi").select("size", *[(F.col(f"e_{h}") - F.col(f"s_{h}")).alias(h) for h in names]).distinct()

    key = ["size", *names]
    joined = clades(index_a or index_tree(tree_a)).withColumn("a", F.lit(1)).join(clades(index_tree(tree_b)).withColumn("b", F.lit(1)), key, "full_outer")
    return joined.agg(
        F.count(F.when(F.col("b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_b")
    ).select("only_a", "only_b", (F.col("only_a") + F.col("only_b")).alias("difference"))


def membership_to_tree(membership: DataFrame, levels: Sequence[str]) -> DataFrame:
    """``(id, *levels)`` from finest to coarsest cluster ids -> tree; leaf id = point id, internal
    ids follow the largest point id level by level."""
    base = membership.agg(F.max("id").alias("m"), *[F.max(c).alias(c) for c in levels]).first()
    offset, offsets = base["m"] + 1, {}
    for c in levels:
        offsets[c] = offset
        offset += base[c] + 1
    names = [F.col("id").cast("long"), *[(F.col(c) + offsets[c]).cast("long") for c in levels], F.lit(None).cast("long")]
    links = F.array(*[F.struct(names[i].alias("node"), names[i + 1].alias("parent"), F.lit(i == 0).alias("is_leaf")) for i in range(len(levels) + 1)])
    exploded = membership.select(F.explode(links).alias("e")).select("e.*")
    return exploded.groupBy("node", "parent", "is_leaf").agg(F.count(F.lit(1)).alias("size"))

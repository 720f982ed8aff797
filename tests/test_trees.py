"""Hand fixtures for trees: eight leaves, seven merges, a truth tree of three classes."""

import pytest

from grovelight.operators import tree_scores as ts, trees as tr

MERGES = [(8, 0, 1, 1.0, 2), (9, 3, 4, 1.5, 2), (10, 6, 7, 2.0, 2), (11, 2, 9, 2.5, 3), (12, 5, 11, 3.0, 4), (13, 8, 12, 4.0, 6), (14, 10, 13, 5.0, 8)]
TRUTH = {8: [0, 1, 2], 9: [3, 4, 5], 10: [6, 7], 11: [8, 9], 12: [11, 10]}
LABELS = "aaabbbcc"


@pytest.fixture(scope="module")
def merges(spark):
    return spark.createDataFrame(MERGES, "node long, left long, right long, height double, size long").cache()


@pytest.fixture(scope="module")
def truth(spark):
    parent = {c: p for p, cs in TRUTH.items() for c in cs}

    def size(v):
        return sum(size(c) for c in TRUTH[v]) if v in TRUTH else 1

    rows = [(v, parent.get(v), size(v), v < 8) for v in range(13)]
    return spark.createDataFrame(rows, "node long, parent long, size long, is_leaf boolean").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(list(enumerate(LABELS)), "id long, label string").cache()


def test_exact_scores(merges, truth, labels):
    tree = tr.tree_from_merges(merges)
    assert ts.dendrogram_purity(tree, labels).first()[0] == pytest.approx(0.785714, abs=1e-6)
    assert ts.lca_f1(tree, truth, labels).first()[0] == pytest.approx(0.806803, abs=1e-6)


def test_sampled_scores_are_near_the_exact_ones(merges, truth, labels):
    tree = tr.tree_from_merges(merges)
    assert ts.dendrogram_purity_sampled(tree, labels, 400).first()[0] == pytest.approx(0.785714, abs=0.05)
    assert ts.lca_f1_sampled(tree, truth, labels, 400).first()[0] == pytest.approx(0.806803, abs=0.05)


@pytest.mark.parametrize("by_size", [False, True])
def test_cuts(spark, merges, by_size):
    levels = spark.createDataFrame([(2,), (3,), (4,)], "k long")
    cut = tr.cut_by_size(tr.tree_from_merges(merges), levels) if by_size else tr.cut_by_height(merges, levels)
    found: dict = {}
    for r in cut.collect():
        found.setdefault(r["k"], {}).setdefault(r["cluster"], set()).add(r["id"])
    assert sorted(map(sorted, found[2].values())) == [[0, 1, 2, 3, 4, 5], [6, 7]]
    assert sorted(map(sorted, found[3].values())) == [[0, 1], [2, 3, 4, 5], [6, 7]]
    assert sorted(map(sorted, found[4].values())) == [[0, 1], [2, 3, 4], [5], [6, 7]]


def test_clade_difference(merges, truth):
    row = tr.clade_difference(tr.tree_from_merges(merges), truth).first()
    assert (row["only_a"], row["only_b"], row["difference"]) == (4, 2, 6)


def test_truth_tree_promotes_single_children(spark):
    df = spark.createDataFrame([(0, "x", "p"), (1, "x", "p"), (2, "x", "q"), (3, "y", "r")], "id long, category_0 string, category_1 string")
    parents = {r["node"]: r["parent"] for r in tr.ground_truth_tree(df, 2).collect()}
    assert parents[0] == parents[1] == 4 and parents[2] == 5 and parents[3] == 6
    assert parents[4] == parents[5] == 7 and parents[6] == parents[7] == 8 and parents[8] is None


def test_only_the_last_merge_counts_when_merging_stopped(spark):
    merges = spark.createDataFrame([(4, 0, 1, 1.0, 2), (5, 2, 3, 2.0, 2)], "node long, left long, right long, height double, size long")
    assert sorted(r["node"] for r in tr.tree_from_merges(merges).collect()) == [2, 3, 5]

"""Leaves that hang from one node and have the same labels are scored as one."""

import pytest

from grovelight.operators import tree_scores as ts, trees as tr


def trees(spark, n, twice=()):
    rows = [(i, f"p{i % 3}", f"q{i % 2}", None if i % 11 == 0 else f"c{i % 5}") for i in [*range(n), *twice]]
    df = spark.createDataFrame(rows, "id long, category_0 string, category_1 string, label string").cache()
    other = df.selectExpr("id", "category_1 AS category_0", "category_0 AS category_1")
    return tr.ground_truth_tree(df, 2).cache(), tr.ground_truth_tree(other, 2).cache(), df.select("id", "label")


def test_scores_work_on_folded_leaves(spark, monkeypatch):
    pred, truth, labels = trees(spark, 240)
    index = tr.index_tree(pred)
    whole = ts.dendrogram_purity(pred, labels, index).first()[0], ts.lca_f1(pred, truth, labels, index).first()[0]
    seen, meet = [], tr.meeting_nodes
    monkeypatch.setattr(ts, "meeting_nodes", lambda index, members, *a: (seen.append(members.count()), meet(index, members, *a))[1])
    assert ts.dendrogram_purity(pred, labels).first()[0] == pytest.approx(whole[0])
    assert ts.lca_f1(pred, truth, labels).first()[0] == pytest.approx(whole[1])
    assert seen[0] <= 6 * 5 and seen[1] <= 6 * 5 * 3, seen  # not one row a leaf


def test_repeated_leaves_are_not_folded(spark):
    pred, truth, labels = trees(spark, 30, twice=(4, 7))
    index = tr.index_tree(pred)
    assert tr.fold_leaves(pred, labels.selectExpr("id AS leaf", "1 AS copies", "label"), index.scratch) is None
    assert ts.lca_f1(pred, truth, labels).first()[0] == pytest.approx(ts.lca_f1(pred, truth, labels, index).first()[0])

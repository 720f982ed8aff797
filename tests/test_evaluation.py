"""An evaluation that is killed half-way goes on where it stopped, and no method is there twice."""

import threading

import numpy as np
import pytest

from grovelight.operators import clustering as c, tree_scores as ts, trees as tr
from grovelight.plans.evaluation import evaluate, kmeans_tree
from grovelight.sources.runs import Ledger
from grovelight.sources.scratch import Scratch


def test_a_killed_run_resumes(spark):
    x = np.concatenate([np.zeros((6, 2)), np.ones((6, 2)) * 9]) + np.random.default_rng(0).normal(size=(12, 2)) * 0.1
    points = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")
    labels = spark.createDataFrame([(i, "lo" if i < 6 else "hi") for i in range(12)], "id long, category_0 string")
    folder, calls, dead = f"{Scratch(spark).root}/run", [], [True]

    def linkage(p):
        calls.append("linkage")
        return c.single_linkage_tree(p)

    def tree(p):
        calls.append("tree")
        if dead[0]:
            raise RuntimeError("killed")
        return kmeans_tree(p, (2,))

    plan = {"reductions": {"Raw": lambda p: p}, "clusterers": {"linkage": linkage, "tree": tree}}
    with pytest.raises(RuntimeError, match="killed"):
        evaluate(points, labels, 1, folder, "m", **plan)
    assert calls == ["linkage", "tree"] and list(Ledger(spark, folder).parts()) == ["m\tRaw\tlinkage"]
    # what a crash between the part and its commit leaves does not count
    Ledger(spark, folder).results().write.parquet(f"{folder}/parts/left-over")
    dead[0] = False
    rows = evaluate(points, labels, 1, folder, "m", **plan).collect()
    assert calls == ["linkage", "tree", "tree"]
    assert sorted(r["cluster_method"] for r in rows) == ["linkage", "tree"]
    assert all(r["ari"] == pytest.approx(1.0) and r["dendrogram_purity"] == pytest.approx(1.0) for r in rows)
    assert {r["cluster_method"]: r["tree_difference"] for r in rows}["tree"] == 0
    again = evaluate(points, labels, 1, folder, "m", **plan).collect()
    assert len(calls) == 3 and sorted(map(repr, again)) == sorted(map(repr, rows))
    assert not Ledger(spark, folder).commit("m\tRaw\ttree", evaluate(points, labels, 1, folder, "m", **plan))


def test_methods_run_side_by_side(spark):
    points = spark.createDataFrame([(i, [float(i % 2)]) for i in range(4)], "id long, vec array<double>")
    labels = spark.createDataFrame([(i, str(i % 2)) for i in range(4)], "id long, category_0 string")
    both = threading.Barrier(2)

    def tree(p):
        both.wait(120)  # broken where one method waits for the other to end
        return kmeans_tree(p, (2,))

    rows = evaluate(points, labels, 1, f"{Scratch(spark).root}/run", "m", {"Raw": lambda p: p}, {"a": tree, "b": tree}).collect()
    assert sorted(r["cluster_method"] for r in rows) == ["a", "b"] and all(r["ari"] == pytest.approx(1.0) for r in rows)


def test_all_levels_are_scored_from_the_same_meeting_nodes(spark, monkeypatch):
    rows = [(i, f"p{i % 2}", None if i == 5 else f"q{i % 3}") for i in range(12)]
    labels = spark.createDataFrame(rows, "id long, category_0 string, category_1 string").cache()
    truth = tr.ground_truth_tree(labels, 2).cache()
    merges = [(12 + i, 0 if i == 0 else 11 + i, i + 1, float(i), i + 2) for i in range(11)]
    index = tr.index_tree(tr.tree_from_merges(spark.createDataFrame(merges, "node long, left long, right long, height double, size long")))
    expected = []
    for number in range(2):
        one = labels.selectExpr("id", f"category_{number} AS label")
        expected.append((number, ts.dendrogram_purity(index.nodes, one, index).first()[0], ts.lca_f1(index.nodes, truth, one, index).first()[0]))
    calls, meet = [], tr.meeting_nodes
    monkeypatch.setattr(ts, "meeting_nodes", lambda *a: (calls.append(1), meet(*a))[1])
    long = labels.selectExpr("id", "stack(2, 0, category_0, 1, category_1) AS (level_idx, label)")
    found = sorted(tuple(r) for r in ts.level_scores(index, truth, long).collect())
    assert len(calls) == 1 and [f[0] for f in found] == [0, 1]
    assert [v for f in found for v in f] == pytest.approx([v for e in expected for v in e])

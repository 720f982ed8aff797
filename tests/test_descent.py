"""Neighbour descent against exact neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovelight.operators import descent, pivots as pv, reductions as rd


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>").cache()


def pairs(df):
    return {(r["i"], r["j"]) for r in df.collect()}


@pytest.mark.parametrize("spread", [0.0, 8.0])
def test_descent_finds_what_short_runs_miss(spark, spread):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(rng.normal(size=6) * spread, 1, (150, 6)) for _ in range(8)])
    points = table(spark, x)
    exact = pairs(pv.knn_graph(points, 8))
    start = rd.knn_graph_approx(points, 8, projections=1, window=16)
    found = descent.refine(points, start, 8).cache()
    before, after = len(pairs(start) & exact) / len(exact), len(pairs(found) & exact) / len(exact)
    assert before < 0.6 and after >= 0.95, (before, after)
    assert found.groupBy("i").count().where("count <> 8").count() == 0 and found.where("i = j").count() == 0
    r = found.where("rank = 8").orderBy("i").first()
    assert r["d"] == pytest.approx(np.sqrt(((x[r["i"]] - x[r["j"]]) ** 2).sum()))
    assert len(pairs(descent.knn_graph_descent(points, 8, window=32)) & exact) / len(exact) >= 0.95


def test_few_points_copies_and_empty(spark):
    few = descent.knn_graph_descent(table(spark, np.arange(5.0)[:, None]), 8)
    assert pairs(few) == {(i, j) for i in range(5) for j in range(5) if i != j}
    copies = descent.knn_graph_descent(table(spark, np.ones((300, 2))), 4, window=8).cache()
    assert copies.groupBy("i").count().where("count <> 4").count() == 0 and copies.where("d > 0").count() == 0
    none = spark.createDataFrame([], "id long, vec array<double>")
    assert descent.knn_graph_descent(none, 3).count() == 0


def test_weights_take_given_neighbours(spark):
    points = table(spark, np.random.default_rng(4).normal(size=(60, 3)))
    near = pv.knn_graph(points, 20).cache()
    same = lambda a, b: a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    rounded = lambda df, c: df.withColumn(c, F.round(c, 9))
    assert same(rounded(rd.fuzzy_knn_graph(points, 5), "w"), rounded(rd.fuzzy_knn_graph(points, 5, near), "w"))
    assert same(rounded(rd.perplexity_affinities(points, 5), "p"), rounded(rd.perplexity_affinities(points, 5, near), "p"))
    assert same(rounded(rd.alpha_decay_operator(points, 5, 10), "w"), rounded(rd.alpha_decay_operator(points, 5, 10, near), "w"))


def test_vectors_are_sent_once_an_edge(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 5))
    x[:40] = x[0]  # a hub of copies
    points = table(spark, x)
    start = rd.knn_graph_approx(points, 6, projections=1, window=16)
    monkeypatch.setattr(descent, "_proposals", lambda state: pytest.fail("a pair is not joined to two vectors"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")  # groups go over several batches
    try:
        found = descent.refine(points, start, 6, rounds=2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # the same two rounds, pair by pair
    held, edges = 10, {}
    key = lambda i, j: (float(np.sqrt(sum((a - b) ** 2 for a, b in zip(x[i], x[j])))), j)
    for r in start.collect():
        edges.setdefault(r["i"], {})[r["j"]] = True
    for _ in range(2):
        asked = {i: set() for i in edges}
        for i, near in edges.items():
            for via, f1 in near.items():
                asked[i] |= {j for j, f2 in edges[via].items() if f1 or f2}
                asked[via] |= {i} if f1 else set()
                for j, f2 in near.items():
                    asked[via] |= {j} if f1 or f2 else set()
        edges = {
            i: {j: j not in near for j in sorted({*near, *asked[i]} - {i}, key=lambda j: key(i, j))[:held]} for i, near in edges.items()
        }
    expected = {(i, j) for i, near in edges.items() for j in sorted(near, key=lambda j: key(i, j))[:6]}
    assert {(r["i"], r["j"]) for r in found} == expected

"""Copies, boundaries, large counts and equal levels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovelight.functions.ordering import with_position, with_value_rank
from grovelight.operators import clustering as c, quality as q, reductions as rd, tree_scores as ts, trees as tr
from grovelight.plans.benchmark import flat_level_scores
from grovelight.sources import scratch


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")


@pytest.fixture(scope="module")
def copies(spark):
    x = np.random.default_rng(3).normal(size=(48, 4))
    x[:8] = x[0]
    return table(spark, x)


def test_triplets_of_copies(copies):
    rows = copies.sparkSession.createDataFrame(rd.mine_triplets(copies, n_in=6, n_out=4, n_rand=2).toPandas())
    assert rows.where("isnan(weight) or weight is null or anchor = far or near = far").count() == 0
    per_pair = rows.groupBy("anchor", "near").count()
    assert per_pair.agg(F.min("count")).first()[0] >= 1


def test_pairs_of_copies(copies):
    kinds = {(r["i"], r["kind"]): r["n"] for r in rd.mine_pairs(copies, n_near=5, n_mid=3, n_far=9, extra=10).groupBy("i", "kind").agg(F.count_distinct("j").alias("n")).collect()}
    assert all(kinds[i, "near"] == 5 and kinds[i, "far"] == 9 and kinds[i, "mid"] >= 1 for i in range(48))


def test_words_with_accents(spark):
    df = spark.createDataFrame([(0, "Airéeux über niño"), (1, "airéeux"), (2, "air eux ber ni o")], "id long, t string")
    v = {r["id"]: np.array(r["vec"]) for r in rd.embed_text(df, "t", 512).collect()}
    assert v[0] @ v[1] > 0 and v[0] @ v[2] == pytest.approx(0.0)


@pytest.mark.parametrize("n, k", [(23, 15), (30, 15), (8, 4)])
def test_neighbour_scores_need_enough_points(spark, n, k):
    points = table(spark, np.random.default_rng(n).normal(size=(n, 3)))
    row = q.neighbour_scores(points, points.select("id", F.slice("vec", 1, 1).alias("vec")), k).first()
    assert row["trustworthiness"] is None and row["continuity"] is None


def test_pair_counts_do_not_overflow(spark):
    n = 4_000_000_000
    assert spark.range(1).select(ts._choose2(F.lit(n))).first()[0] == pytest.approx(n * (n - 1) / 2)


def test_pairs_follow_class_sizes(spark):
    labels = spark.createDataFrame([(i, "a" if i < 30 else "b" if i < 40 else "c") for i in range(41)], "id long, label string")
    rows = ts.sample_class_pairs(labels, 4000, 9).groupBy("label").count().collect()
    share = {r["label"]: r["count"] / 4000 for r in rows}
    assert set(share) == {"a", "b"} and share["a"] == pytest.approx(435 / 480, abs=0.02)


def test_levels_of_one_size_stay_apart(spark):
    x = np.concatenate([np.zeros((6, 2)), np.ones((6, 2)) * 9]) + np.random.default_rng(0).normal(size=(12, 2)) * 0.1
    labels = spark.createDataFrame([(i, "lo" if i < 6 else "hi", "even" if i % 2 else "odd") for i in range(12)], "id long, category_0 string, category_1 string")
    merges = c.single_linkage_tree(table(spark, x))
    rows = {r["level_idx"]: r for r in flat_level_scores(merges, labels, 2).collect()}
    assert set(rows) == {0, 1} and rows[0]["level"] == rows[1]["level"] == 2
    assert rows[0]["ari"] == pytest.approx(1.0) and rows[1]["ari"] < 0.5


def test_clades_of_two_trees(spark):
    one = spark.createDataFrame([(0, 4, 1, True), (1, 4, 1, True), (2, 5, 1, True), (3, 6, 1, True), (4, 5, 2, False), (5, 6, 3, False), (6, None, 4, False)], "node long, parent long, size long, is_leaf boolean")
    other = spark.createDataFrame([(0, 4, 1, True), (1, 4, 1, True), (2, 5, 1, True), (3, 5, 1, True), (4, 6, 2, False), (5, 6, 2, False), (6, None, 4, False)], "node long, parent long, size long, is_leaf boolean")
    row = tr.clade_difference(one, other).first()
    assert (row["only_a"], row["only_b"], row["difference"]) == (1, 1, 2)
    assert {r["node"]: r["depth"] for r in tr.depths(one).collect()} == {6: 0, 5: 1, 3: 1, 4: 2, 2: 2, 0: 3, 1: 3}


def test_ranks_of_rows(spark):
    rng = np.random.default_rng(1)
    data = [(i % 2, float(v), float(w)) for i, (v, w) in enumerate(zip(rng.integers(0, 9, 400), rng.integers(1, 4, 400)))]
    df = spark.createDataFrame(data, "g int, x double, w double").repartition(5)
    for r in with_value_rank(df, "x", "rank", F.col("w"), ["g"]).collect():
        mine = [(x, w) for g, x, w in data if g == r["g"]]
        below, tied = sum(w for x, w in mine if x < r["x"]), sum(w for x, w in mine if x == r["x"])
        assert r["rank"] == pytest.approx(below + (tied + 1) / 2)


def test_written_folders_are_closed(spark):
    with_position(spark.range(5), F.col("id"), "pos").count()
    roots = list(scratch._ROOTS[spark.sparkContext.applicationId])
    scratch.close(spark)
    import os

    assert roots and not any(os.path.exists(r.removeprefix("file:")) for r in roots)

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovelight.operators import pivots as pv, quality as q, reductions as rd


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")


@pytest.fixture(scope="module")
def high(spark):
    return table(spark, [(i, i * i % 7) for i in range(10)]).cache()


def test_neighbour_ranks(high):
    low = high.select("id", F.slice("vec", 1, 1).alias("vec"))
    assert q.trustworthiness(high, low, 2).first()[0] == pytest.approx(0.9, abs=1e-6)
    assert q.continuity(high, low, 2).first()[0] == pytest.approx(0.915385, abs=1e-6)


def test_same_space_is_perfect(high):
    row = q.neighbour_scores(high, high, 2).first()
    assert (row["trustworthiness"], row["continuity"]) == (1.0, 1.0)
    assert q.distance_spearman(high, high).first()[0] == pytest.approx(1.0)


def test_shortest_paths_both_ways(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 5.0), (3, 4, 1.0)], "i long, j long, w double")
    points = spark.range(5)
    want = {(0, 1): 1.0, (0, 2): 3.0, (1, 2): 2.0, (3, 4): 1.0}
    for rows in (1000, 2, 1):
        got = {(r["i"], r["j"]): r["g"] for r in q.shortest_paths(edges, points, rows=rows).collect()}
        assert len(got) == 10 and {k: v for k, v in got.items() if v is not None} == want


def test_shortest_paths_across_many_parts(spark):
    """Long ways that cross the borders of the parts many times, in two groups, against relaxation in numpy."""
    rng = np.random.default_rng(5)
    n, rows, want = 60, [], {}
    for g in ("a", "b"):
        d = np.full((n, n), np.inf)
        np.fill_diagonal(d, 0)
        for i, j in [(i, i + 1) for i in range(40)] + [tuple(rng.integers(0, 50, 2)) for _ in range(20)]:
            w = float(rng.random())
            rows.append((g, int(i), int(j), w))
            if i != j:
                d[i, j] = d[j, i] = min(d[i, j], w)
        for k in range(n):
            d = np.minimum(d, d[:, k, None] + d[k])
        want |= {(g, i, j): d[i, j] for i in range(n) for j in range(i + 1, n)}
    points = spark.range(n).withColumn("g0", F.explode(F.array(F.lit("a"), F.lit("b"))))
    edges = spark.createDataFrame(rows, "g0 string, i long, j long, w double")
    got = {(r["g0"], r["i"], r["j"]): r["g"] for r in q.shortest_paths(edges, points, ["g0"], rows=7).collect()}
    assert got.keys() == want.keys()
    assert all(v == pytest.approx(want[k]) if v is not None else np.isinf(want[k]) for k, v in got.items())


def test_tiles_agree_with_numpy_and_with_groups(spark):
    x = np.random.default_rng(0).normal(size=(90, 6))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(90) for j in np.argsort(d[i])[:4]}
    points = table(spark, x)
    assert {(r["i"], r["j"]) for r in pv.knn_graph(points, 4).collect()} == want
    twice = points.withColumn("g", F.explode(F.array(F.lit("a"), F.lit("b"))))
    assert pv.knn_graph(twice, 4, by=["g"]).count() == 2 * len(want)
    approx = {(r["i"], r["j"]) for r in rd.knn_graph_approx(points, 4, projections=3, window=20).collect()}
    assert len(approx & want) / len(want) > 0.8


def test_fuzzy_rows_and_perplexity(spark):
    x = np.random.default_rng(6).normal(size=(40, 3))
    points = table(spark, x)
    p = rd.perplexity_affinities(points, 4)
    assert p.agg(F.sum("p")).first()[0] == pytest.approx(1.0, abs=1e-9)
    w = rd.fuzzy_knn_graph(points, 5).agg(F.min("w"), F.max("w")).first()
    assert 0 < w[0] and w[1] <= 1.0


def test_pca_matches_eigenvectors(spark):
    x = np.random.default_rng(7).normal(size=(30, 4)) * [4, 2, 1, 0.5]
    got = {r["id"]: r["vec"] for r in rd.pca(table(spark, x), 2).collect()}
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred)
    top = vectors[:, np.argsort(values)[::-1][:2]]
    top = top * np.sign(top[np.abs(top).argmax(0), range(2)])
    assert np.allclose(np.array([got[i] for i in range(30)]), centred @ top, atol=1e-8)


def test_rank_tiles_carry_numbers_not_vectors(spark, monkeypatch):
    """Each wanted pair costs a tile its id and its distance, whatever the width; blocks grow to what a task can hold."""
    from grovelight.operators import tiles as t

    x = np.round(np.random.default_rng(9).normal(size=(90, 16)), 1)
    x[5] = x[6]
    points = table(spark, x)
    pairs = spark.createDataFrame([(i, (i * 7 + s) % 90) for i in range(90) for s in (1, 3, 11) if i != (i * 7 + s) % 90], "i long, j long")
    seen, plain = [], t.tiles

    def watched(points, by=(), more=(), tiling=None):
        arrays = [c for c in ("vec", *more) if points.schema[c].dataType.typeName() == "array"]
        seen.append(points.agg(F.sum(sum(F.size(c) for c in arrays))).first()[0])
        return plain(points, by, more, tiling)

    monkeypatch.setattr(t, "tiles", watched)
    got = {(r["i"], r["j"]): r["rank"] for r in t.ranks_of_pairs(points, pairs).collect()}
    assert seen == [90 * 16 + 2 * pairs.count()]
    d = t.exact_square(x, x)
    for (i, j), rank in got.items():
        assert rank == 1 + sum((d[i, c], c) < (d[i, j], j) for c in range(90) if c != i)
    assert len(got) == pairs.distinct().count()
    assert t.tiling_for(spark, 100_000, 1, 1 << 30, 8192).blocks < t.tiling_for(spark, 100_000, 1, 1 << 30).blocks / 7


def test_one_part_of_nodes_has_no_border(spark, monkeypatch):
    """A graph of more nodes than a block of rows is settled in one round, in which nothing is sent."""
    n, rounds, cut = 1300, [], q.Scratch.cut
    edges = spark.range(n - 1).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.lit(1.0).alias("w"))

    def watched(self, df, name="state", keep=0):
        rounds.extend([name] if name == "paths" else [])
        return cut(self, df, name, keep)

    monkeypatch.setattr(q.Scratch, "cut", watched)
    row = q.shortest_paths(edges, spark.range(n)).agg(F.count("g").alias("n"), F.max(F.abs(F.col("g") - F.col("j") + F.col("i"))).alias("off")).first()
    assert (row["n"], row["off"]) == (n * (n - 1) // 2, 0.0) and len(rounds) == 1


def test_spearman_keeps_of_a_pair_what_the_next_step_needs(spark, monkeypatch):
    """No pair is written before it is ranked, and none with a distance whose rank is known."""
    written, cut = [], q.Scratch.cut

    def seen(self, df, name="state", keep=0):
        written.append((name, set(df.columns)))
        return cut(self, df, name, keep)

    monkeypatch.setattr(q.Scratch, "cut", seen)
    rows = np.random.default_rng(8).normal(size=(40, 3))
    high, low = table(spark, rows), table(spark, rows[:, :1])
    ranks = lambda x: (x[:, None] > x[None, :]).sum(1) + ((x[:, None] == x[None, :]).sum(1) + 1) / 2
    full = lambda x: np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)).ravel()
    want = np.corrcoef(ranks(full(rows)), ranks(full(rows[:, :1])))[0, 1]
    assert q.distance_spearman(high, low).first()[0] == pytest.approx(want)
    assert [name for name, _ in written] == ["ranges", "ranges"]
    assert "d" not in written[1][1] and "w" not in written[0][1]


def test_blocks_are_dealt_once_and_whole_tables_go_through_pivots(spark, monkeypatch):
    """No tile gets its blocks through a shuffle or the driver, in one group or two; neighbours of a table of different ids are not compared in tiles."""
    from grovelight.operators import tiles as t

    x = np.random.default_rng(3).normal(size=(150, 3))
    points = table(spark, x)
    two = points.withColumn("g", F.explode(F.array(F.lit("a"), F.lit("b"))))
    for df, by in ((points, []), (two, ["g"])):
        tiled = t.tiles(df, by)
        plan = tiled._jdf.queryExecution().sparkPlan().toString()
        assert "CartesianProduct" in plan and "BroadcastExchange" not in plan
        # a row of each group in each block meets every other row once
        pairs = tiled.select(*by, (F.size("l_ids") * F.size("r_ids")).alias("n"), (F.col("_l") == F.col("_r")).alias("same"))
        assert {r["n"] for r in pairs.groupBy(*by).agg(F.sum(F.when(F.col("same"), F.col("n")).otherwise(2 * F.col("n"))).alias("n")).collect()} == {150 * 150}
    wide = t.tiling_for(spark, 600_000, 1, 320 << 20, 8192)
    assert wide.partitions(8) <= wide.blocks and wide.size * wide.blocks / wide.partitions(8) ** 2 <= t.TASK_BYTES
    low = points.select("id", F.slice("vec", 1, 2).alias("vec"))
    want = q.neighbour_scores(two.where("g = 'a'"), low.withColumn("g", F.lit("a")), 5, ["g"]).first()
    monkeypatch.setattr(t, "nearest_in_groups", lambda *a: pytest.fail("compared in tiles"))
    assert q.trustworthiness(points, low, 5).first()[0] == pytest.approx(want["trustworthiness"])
    assert q.continuity(points, low, 5).first()[0] == pytest.approx(want["continuity"])


def test_the_graph_is_not_sent_once_a_block(spark, monkeypatch):
    """However many blocks of sources there are, a graph that a task can hold is written once, and lengths once, in one triangle."""
    n, written, cut = 400, {}, q.Scratch.cut

    def watched(self, df, name="state", keep=0):
        out = cut(self, df, name, keep)
        written[name] = out.count()
        return out

    monkeypatch.setattr(q.Scratch, "cut", watched)
    monkeypatch.setattr(q, "CELL_BYTES", 8 * n * 5)  # five sources a block: eighty blocks
    edges = spark.range(n - 1).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.lit(1.0).alias("w"))
    paths = q.shortest_paths(edges, spark.range(n))
    row = paths.agg(F.count("g").alias("n"), F.max(F.abs(F.col("g") - F.col("j") + F.col("i"))).alias("off")).first()
    assert (row["n"], row["off"]) == (n * (n - 1) // 2, 0.0)
    assert (written["graph"], written["paths"]) == (2 * (n - 1), n * (n - 1) // 2)

"""Searches through pivots: the same rows as all pairs, and most blocks left out where points are clustered."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grovelight.operators import pivots as pv
from grovelight.sources.scratch import Scratch


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>").repartition(3)


def clusters(count, each, dim, spread, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(count, dim)) * 10
    return np.concatenate([c + rng.normal(size=(each, dim)) * spread for c in centres])


def brute(x, k, include_self):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), d[i])) if include_self or j != i][:k]
        out += [(i, int(j), r + 1) for r, j in enumerate(order)]
    return out


@pytest.mark.parametrize("include_self", [False, True])
def test_neighbours_match_all_pairs(spark, include_self):
    x = np.concatenate([clusters(6, 25, 5, 0.3), np.zeros((12, 5)), np.random.default_rng(1).normal(size=(30, 5)) * 20])
    x = np.round(x, 3)
    got = sorted((r["i"], r["j"], r["rank"]) for r in pv.nearest(table(spark, x), 6, include_self).collect())
    assert got == sorted(brute(x, 6, include_self))


def test_fewer_points_than_asked_for(spark):
    x = np.random.default_rng(2).normal(size=(4, 3))
    assert pv.nearest(table(spark, x), 9).count() == 12
    assert pv.nearest(table(spark, x[:1]), 3).count() == 0
    assert pv.nearest(table(spark, x).limit(0), 3).count() == 0


def test_most_blocks_are_left_out(spark):
    """A search of clustered points meets a small part of all (row, cell) pairs; one without a bound meets all."""
    x = clusters(30, 40, 16, 0.2)
    points, scratch = table(spark, x), Scratch(spark)
    index = pv.build(points, scratch)
    near = pv.nearest(points, 5, index=index)
    assert near.count() == 5 * len(x)
    met = pv.route(index, points, wanted=6).agg(F.sum(F.size("l_ids"))).first()[0]
    assert met < 0.25 * len(x) * len(index.centres)
    assert pv.route(index, points.withColumn("bound", F.lit(float("inf"))), []).agg(F.sum(F.size("l_ids"))).first()[0] == len(x) * (index.subs > 0).sum()


def test_radius_searches(spark):
    x = np.round(clusters(8, 20, 3, 0.5, 4), 1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    pairs = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= 0.6}
    assert {(r["i"], r["j"]) for r in pv.pairs_within(table(spark, x), 0.6).collect()} == pairs
    lower = {}
    for i in range(1, len(x)):
        j = int(np.argmin(d[i, :i]))
        if d[i, j] < 0.6:
            lower[i] = j
    assert {r["i"]: r["j"] for r in pv.nearest_within(table(spark, x), 0.6).collect()} == lower


def test_points_may_leave_an_index(spark):
    x = np.round(clusters(5, 12, 3, 0.4, 8), 3)
    points = table(spark, x)
    index = pv.build(points, Scratch(spark))
    left = points.where("id % 3 <> 0")
    got = sorted((r["i"], r["j"], r["rank"]) for r in pv.nearest(left, 4, index=index.only(left.select("id"), 20)).collect())
    ids = [i for i in range(60) if i % 3]
    assert got == sorted((ids[i], ids[j], r) for i, j, r in brute(x[ids], 4, False))


def test_large_cells_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(pv.t, "ROWS_PER_BLOCK", 8)
    monkeypatch.setattr(pv.t, "SMALL_BYTES", 0)
    x = np.random.default_rng(6).normal(size=(150, 2))
    got = sorted((r["i"], r["j"], r["rank"]) for r in pv.nearest(table(spark, x), 3).collect())
    assert got == sorted(brute(x, 3, False))


def test_a_search_keeps_only_the_nearest_of_a_row(spark, monkeypatch):
    """However many cells a row looks into, one task holds it and sends its k nearest, and blocks come once a group."""
    monkeypatch.setattr(pv.t, "SMALL_BYTES", 0)
    x = np.random.default_rng(7).normal(size=(400, 8))
    points = table(spark, x)
    index = pv.build(points, Scratch(spark))
    sent = pv.search(index, points, pv._nearest_kernel(5, False), "i long, j long, d double", wanted=6, best=(5, ("d", "j")))
    assert sent.count() == 5 * len(x)
    cells = pv.route(index, points, wanted=6)
    groups = cells.select("grp").distinct().count()
    assert cells.select("grp", "cell").distinct().count() <= groups * len(index.centres) and groups <= 1 + len(x) // pv.MIN_GROUP * 2
    assert "l_flat" not in cells.columns


def test_copies_of_an_id_share_their_neighbours(spark):
    x = np.random.default_rng(8).normal(size=(40, 3))
    twice = table(spark, x).unionByName(table(spark, x))
    rows = pv.nearest(twice, 4).groupBy("i").count().collect()
    assert len(rows) == 40 and {r["count"] for r in rows} == {4}


def test_no_search_asks_for_a_broadcast_of_its_blocks(spark):
    points = table(spark, np.random.default_rng(9).normal(size=(60, 4)))
    index = pv.build(points, Scratch(spark))
    sent = pv.search(index, points, pv._nearest_kernel(3, False), "i long, j long, d double", wanted=4, best=(3, ("d", "j")))
    assert "strategy=broadcast" not in sent._jdf.queryExecution().optimizedPlan().toString()


def test_points_are_placed_a_packet_at_a_time():
    """A batch of 10,000 rows and 1,024 pivots: no more than a packet's table of distances is held."""
    rng = np.random.default_rng(6)
    x, centres = rng.normal(size=(10_000, 8)), rng.normal(size=(1024, 8))
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, 80_001, 8), pa.int32()), pa.array(x.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), flat], ["id", "vec"])
    tracemalloc.start()
    found = list(pv._with_cells(iter([batch]), centres))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and sum(f.num_rows for f in found) == 10_000
    cells = np.concatenate([f.column("cell").to_numpy() for f in found])
    assert (cells[:50] == ((x[:50, None] - centres) ** 2).sum(-1).argmin(1)).all()

"""Approximate neighbours refined along the neighbour graph itself."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import square_distance
from ..session import ship_package
from ..sources.scratch import Scratch
from . import tiles as t
from .reductions import knn_graph_approx

PACKET = 1024  # rows whose pairs are measured at once
LAST = (1 << 63) - 1


def _closest(edges: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("i").orderBy("d", "j")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _proposals(state: DataFrame) -> DataFrame:
    """Pairs ``(i, j)`` not yet linked: neighbours of neighbours and rows named by one row, over at least one fresh edge, and fresh
    edges turned round. Their number is linear in the rows: rows that name one hub are not paired with each other."""
    named = state.select(F.col("i").alias("via"), "j", F.col("fresh").alias("f2"))
    on = state.select("i", F.col("j").alias("via"), F.col("fresh").alias("f1")).join(named, "via")
    siblings = state.select(F.col("j").alias("i"), F.col("i").alias("via"), F.col("fresh").alias("f1")).join(named, "via")
    walked = on.unionByName(siblings).where("(f1 OR f2) AND i <> j").select("i", "j")
    turned = state.where("fresh").select(F.col("j").alias("i"), F.col("i").alias("j"))
    return walked.unionByName(turned).distinct().join(state.select("i", "j"), ["i", "j"], "left_anti")


def _pairs_of(groups: np.ndarray, named: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Every row from ``lo`` to ``hi`` with the named rows of its group; rows are sorted by group, the named ones first."""
    starts = np.searchsorted(groups, groups[lo:hi])
    before = np.append(0, np.cumsum(named))
    counts = before[np.searchsorted(groups, groups[lo:hi], side="right")] - before[starts]
    left = np.repeat(np.arange(lo, hi), counts)
    nth = np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts)
    return left, np.repeat(starts, counts) + nth


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(i, j, d)`` of the rows ``(grp, kind, id, fresh, limit, limit_j, vec)`` of a group with its named ones (``kind`` 0): pairs over a
    fresh edge that beat the limit of ``i``. A group may go over several batches."""
    names = ["grp", "kind", "id", "fresh", "limit", "limit_j"]
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        rows["vec"] = np.asarray(batch.column("vec").flatten()).reshape(batch.num_rows, -1)
        rows["done"] = np.zeros(batch.num_rows, bool)
        if held is not None:
            rows = {c: np.concatenate([held[c], v]) for c, v in rows.items()}
        groups, named = rows["grp"], rows["kind"] == 0
        last = int(np.searchsorted(groups, groups[-1]))
        whole = not named[-1]  # else more of the last group's named rows may follow
        for lo in range(0, len(groups) if whole else last, PACKET):
            left, right = _pairs_of(groups, named, lo, min(lo + PACKET, len(groups) if whole else last))
            use = ~rows["done"][left] & (rows["fresh"][left] | rows["fresh"][right]) & (rows["id"][left] != rows["id"][right])
            left, right = left[use], right[use]
            d = np.sqrt(t.exact_square_pairs(rows["vec"][left], rows["vec"][right]))
            i, j, limit = rows["id"][left], rows["id"][right], rows["limit"][left]
            near = (d < limit) | ((d == limit) & (j < rows["limit_j"][left]))
            yield pa.RecordBatch.from_arrays([pa.array(v[near]) for v in (i, j, d)], ["i", "j", "d"])
        keep = np.arange(last, len(groups))
        keep = keep[named[keep]]
        held = {c: v[keep] for c, v in rows.items()}
        held["done"] = np.full(len(keep), whole)
    if held is not None and not held["done"].all():  # the last group has only named rows
        yield from _named_alone(held)


def _named_alone(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    left, right = (x.ravel() for x in np.indices((len(rows["id"]),) * 2))
    use = (rows["fresh"][left] | rows["fresh"][right]) & (rows["id"][left] != rows["id"][right])
    left, right = left[use], right[use]
    d = np.sqrt(t.exact_square_pairs(rows["vec"][left], rows["vec"][right]))
    i, j, limit = rows["id"][left], rows["id"][right], rows["limit"][left]
    near = (d < limit) | ((d == limit) & (j < rows["limit_j"][left]))
    yield pa.RecordBatch.from_arrays([pa.array(v[near]) for v in (i, j, d)], ["i", "j", "d"])


def _better(points: DataFrame, state: DataFrame, farthest: DataFrame, scratch: Scratch) -> DataFrame:
    """The proposals that beat the farthest neighbour of ``i``, measured where they meet: ``(i, j, d)``.

    A vector is sent to the rows that name it and to those it names, once an edge, not once a pair. Edges at which nothing is fresh stay at home.
    """
    ship_package(points.sparkSession)
    rows = scratch.cut(points.join(farthest.withColumnRenamed("i", "id"), "id", "left").select(
        "id", "vec", F.coalesce("worst.d", F.lit(math.inf)).alias("limit"), F.coalesce("worst.j", F.lit(LAST)).alias("limit_j")
    ), "rows", keep=2)
    out_fresh = state.groupBy(F.col("i").alias("grp")).agg(F.max("fresh").alias("out"))
    in_fresh = state.groupBy(F.col("j").alias("grp")).agg(F.max("fresh").alias("in"))
    named = state.select(F.col("i").alias("grp"), F.lit(0).alias("kind"), F.col("j").alias("id"), "fresh")
    named = named.join(out_fresh, "grp").join(in_fresh, "grp", "left").where(F.col("out") | F.col("in")).drop("out", "in")
    namers = state.select(F.col("j").alias("grp"), F.lit(1).alias("kind"), F.col("i").alias("id"), "fresh")
    namers = namers.join(out_fresh, "grp").where(F.col("out") | F.col("fresh")).drop("out")
    sent = named.unionByName(namers).join(rows, "id").select("grp", "kind", "id", "fresh", "limit", "limit_j", "vec")
    found = sent.repartition("grp").sortWithinPartitions("grp", "kind").mapInArrow(_walked, "i long, j long, d double")
    turned = state.where("fresh").select(F.col("j").alias("i"), F.col("i").alias("j"), "d").join(farthest, "i", "left")
    turned = turned.where(F.col("worst").isNull() | (F.struct("d", "j") < F.col("worst"))).select("i", "j", "d")
    once = found.unionByName(turned).groupBy("i", "j").agg(F.min("d").alias("d"))
    return once.join(state.select("i", "j"), ["i", "j"], "left_anti")


def refine(points: DataFrame, edges: DataFrame, k: int, rounds: int = 12, settled: float = 0.001, spare: int | None = None) -> DataFrame:
    """``(i, j, d, rank)``: the neighbour graph ``edges`` ``(i, j, d)`` improved by neighbour descent.

    Each round looks at the neighbours of each row's neighbours, at rows named together with it and at whoever named it, and keeps the
    nearest, ties to the lower id. While it descends a row holds ``spare`` neighbours beyond ``k`` (half of ``k``, at least 4), so that
    fewer rows are stuck between near ones that all name each other. It ends when a round replaces at most ``settled`` of all edges.
    A round measures about ``2 * (k + spare) ** 2`` pairs a row at first and fewer as edges settle, and sends ``2 * (k + spare)`` vectors a row for
    it (where ids repeat, one a pair); only pairs that beat a row's farthest neighbour leave the task and reach its window, so a hub that many rows name, or the first of many copies, is not flooded. Rows with less than ``k``
    neighbours take any; rows out of reach of all others stay without.
    """
    scratch = Scratch(points.sparkSession)
    held = k + (max(4, k // 2) if spare is None else spare)
    a = points.select(F.col("id").alias("i"), F.col("vec").alias("_a"))
    b = points.select(F.col("id").alias("j"), F.col("vec").alias("_b"))
    state = scratch.cut(_closest(edges.select("i", "j", "d"), held).withColumn("fresh", F.lit(True)), "near", keep=2)
    points = points.select("id", "vec")
    once = points.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty() and dict(points.dtypes)["id"] == "bigint"
    for _ in range(rounds):
        farthest = state.groupBy("i").agg(F.when(F.count(F.lit(1)) >= held, F.max(F.struct("d", "j"))).alias("worst"))
        if once:
            better = _better(points, state, farthest, scratch)
        else:
            measured = _proposals(state).join(a, "i").join(b, "j").select("i", "j", F.sqrt(square_distance(F.col("_a"), F.col("_b"))).alias("d"))
            better = measured.join(farthest, "i", "left").where(F.col("worst").isNull() | (F.struct("d", "j") < F.col("worst")))
        both = state.select("i", "j", "d", F.lit(False).alias("fresh")).unionByName(better.select("i", "j", "d", F.lit(True).alias("fresh")))
        state = scratch.cut(_closest(both, held), "near", keep=2)
        seen = state.agg(F.count(F.lit(1)).alias("n"), F.count_if("fresh").alias("fresh")).first()
        if seen.fresh <= settled * seen.n:
            break
    return state.where(F.col("rank") <= k).drop("fresh")


def knn_graph_descent(
    points: DataFrame, k: int, rounds: int = 12, settled: float = 0.001, projections: int = 2, window: int = 64, seed: int = 67
) -> DataFrame:
    """Approximate neighbours ``(i, j, d, rank)``: short runs along random directions, refined by neighbour descent.

    Runs are short because they only start the descent; a row is compared with ``4 * window * projections`` rows there at most. Two parts
    of the data that no run and no neighbour connects stay apart, as with every search along neighbours.
    """
    return refine(points, knn_graph_approx(points, k, projections, max(window, k + 1), seed), k, rounds, settled)

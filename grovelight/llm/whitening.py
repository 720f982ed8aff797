"""Embedding whitening: projections on the leading components, scaled to unit covariance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import scratch
from .spectrum import leading
from .vectors import chunks, exact_total, usual_length, whole

SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"
RANK = 1e-11  # a component whose share of the first one's variance is smaller is rounding, not a direction


def _sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of every dimension: one row a task and dimension is shuffled."""

    def run(batches):
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for _, x in chunks(batches, dim):
            n += len(x)
            high += (x >> 20).sum(0)
            low += (x & ((1 << 20) - 1)).sum(0)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(dim), pa.int32()), "rows": pa.array([n] * dim, pa.int64()), "high": high, "low": low})

    rows = fit.mapInArrow(run, "at int, rows long, high long, low long").groupBy("at").agg(F.sum("rows").alias("n"), exact_total("high", "low").alias("s")).collect()
    return rows[0]["n"], [int(r["s"]) for r in sorted(rows, key=lambda r: r["at"])]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n: the whole part of the mean is taken off exactly, its fraction after that."""
    whole_part = np.array([s // n for s in sums], np.int64)
    fraction = np.array([(s % n) / n for s in sums])
    return (x - whole_part) - fraction


def covariance(fit: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """Products of centred vectors over ``n``. A task shuffles one matrix; only dim ** 2 sums reach the driver."""

    def run(batches):
        total = np.zeros((dim, dim))
        for _, x in chunks(batches, dim):
            c = _centred(x, n, sums)
            total += c.T @ c
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(dim * dim), pa.int64()), "v": total.ravel()})

    out = np.zeros(dim * dim)
    for r in fit.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["cell"]] = r["v"] / n
    return out.reshape(dim, dim)


def _projected(x: np.ndarray, n: int, sums: list[int], values: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Whitened coordinates, summed from the first dimension to the last, so that equal vectors get equal numbers."""
    c = _centred(x, n, sums)
    out = np.zeros((len(x), len(values)))
    for d in range(c.shape[1]):
        out += c[:, d, None] * axes[None, :, d]
    return out / np.sqrt(values)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum of (n * x - S) ** 2, exact; null where it does not fit into a long."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if largest * largest * x.shape[1] < 1 << 63:
        return pa.array((np.square(n * x - np.array(sums, np.int64))).sum(1), pa.int64())
    wide = n * x.astype(object) - np.array(sums, object)
    return pa.array([s if s < 1 << 63 else None for s in (wide * wide).sum(1).tolist()], pa.int64())


def whiten(vectors: DataFrame, components: int = 4, factor: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each usable vector and component.

    Components become whole numbers x = floor(factor * c). Each distinct x counts once: ``n`` of them with sums S. Their covariance is
    gathered as one small matrix, whose leading eigenpairs are found by spectrum slicing (see ``spectrum.leading``). ``deviation`` is the exact
    sum of (n * x - S) ** 2, ``whitened`` the projection of x - S / n over the square root of the eigenvalue, ``explained`` the
    eigenvalue's share of the trace, and ``identity_error`` the largest entry of the whitened covariance minus the identity, as measured
    over the distinct vectors.

    Null vectors and those with null or non-finite entries are left out, as are those of another length than most have (the longer of
    two). Repeated rows and null ids are returned as they come. There are as many components as there are directions with variance, so
    fewer than ``components`` for short or copied vectors, and no rows for a single distinct vector or an empty table. A ``deviation``
    beyond a long is null. Further columns are ignored.
    """
    kind = dict(vectors.dtypes)["vec_id"]
    schema = f"vec_id {kind}, {SCHEMA}"
    place = scratch(vectors.sparkSession)
    points = whole(vectors, factor, "vec_id")
    dim = usual_length(points)
    if not dim:
        return vectors.sparkSession.createDataFrame([], schema)
    points = points.where(F.size("x") == dim)
    fit = place.cut(points.select("x").distinct(), "distinct")
    n, sums = _sums(fit, dim)
    matrix = covariance(fit, dim, n, sums)
    values, axes = leading(matrix, components)
    real = values > RANK * values.max(initial=0.0)
    values, axes, trace = values[real], axes[real], float(np.trace(matrix))
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    names = [f"w{i}" for i in range(len(values))]

    def project(batches):
        for _, x in chunks(batches, dim):
            w = _projected(x, n, sums, values, axes)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(len(names))], names)

    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    measured = fit.mapInArrow(project, ", ".join(f"{c} double" for c in names)).agg(*[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs]).first()
    error = max(abs(measured[f"{a}_{b}"] - (a == b)) for a, b in pairs)
    k = len(values)

    def run(batches):
        for part, x in chunks(batches, dim):
            w = _projected(x, n, sums, values, axes)
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(rows), n), pa.int64()),
                    _deviations(x, n, sums).take(pa.array(rows)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(values / trace, len(x))),
                    pa.array(np.full(len(rows), error)),
                ],
                ["vec_id", *[f.split()[0] for f in SCHEMA.split(", ")]],
            )

    return points.mapInArrow(run, schema)

"""Vectors as whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LARGEST = 1 << 40


def whole(vectors: DataFrame, factor: int, *keep: str) -> DataFrame:
    """(``keep``…, x): every component c as the long floor(factor * c), reckoned in double.

    Null vectors and those with a null or non-finite entry are left out. Numbers beyond 2 ** 40 either way become 2 ** 40, so that
    nothing overflows.
    """
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    cut = lambda c: F.floor(F.least(F.greatest(c * float(factor), F.lit(-float(LARGEST))), F.lit(float(LARGEST))))
    return vectors.select(*keep, v.alias("_v")).where("_v is not null").where(finite).select(*keep, F.transform("_v", cut).alias("x"))


def usual_length(points: DataFrame) -> int:
    """The length that most vectors have, the longer one of two; 0 without vectors."""
    first = points.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return first["width"] if first else 0


def matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def chunks(batches: Iterator[pa.RecordBatch], dim: int, column: str = "x", rows: int = 8192) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of at most ``rows`` rows with their vectors as a matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, matrix(part.column(column), dim)


def exact_total(high, low):
    """A sum of longs from the sums of their upper parts and their lower 20 bits, as a decimal column."""
    return F.sum(F.col(high).cast("decimal(38,0)")) * F.lit(1 << 20).cast("decimal(10,0)") + F.sum(F.col(low).cast("decimal(38,0)"))

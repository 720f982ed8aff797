"""Vector code compression: product codes whose nearest entries are looked up through memoised grid cells."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import scratch
from .lookup import lookup
from .vectors import chunks, exact_total, usual_length, whole

MEMO = 1 << 16  # cells a task remembers; a full memo starts anew, which costs time only


@dataclass(frozen=True)
class Grid:
    """Cells of one width per dimension over the range of all vectors."""

    low: np.ndarray
    high: np.ndarray
    width: np.ndarray

    @staticmethod
    def over(low: list[int], high: list[int], levels: int) -> "Grid":
        lo, hi = np.array(low, np.int64), np.array(high, np.int64)
        return Grid(lo, hi, np.maximum(1, -(-(hi - lo + 1) // levels)))

    def part(self, at: slice) -> "Grid":
        return Grid(self.low[at], self.high[at], self.width[at])


def number_kind(low: np.ndarray, high: np.ndarray):
    """The smallest kind of number in which no squared distance overflows; Python's own beyond that."""
    widest = int((high - low).max(initial=0))
    most = widest * widest * len(low)
    return np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object


class Nearest:
    """The nearest entry of one codebook, for many vectors.

    A vector's grid cell is hashed. For a new cell, the least and the largest distance from its box to every entry are summed up, and the entries
    whose least distance is no more than the smallest of the largest ones are kept: the others are farther than that one from every
    point of the box. Later vectors of the cell are compared with these alone, exactly, ties to the lower index.
    """

    def __init__(self, book: np.ndarray, grid: Grid, levels: int):
        self.kind = number_kind(grid.low, grid.high)
        self.book, self.grid, self.levels = book.astype(self.kind), grid, levels
        self.memo: dict[bytes, int] = {}
        self.kept: list[np.ndarray] = []
        steps = np.arange(levels, dtype=np.int64)[:, None]
        lo = grid.low + steps * grid.width
        hi = np.minimum(lo + grid.width - 1, grid.high)
        lo = np.minimum(lo, hi)
        e = book.T[:, None, :]  # by dimension, step and entry
        under, over = lo.T[:, :, None] - e, e - hi.T[:, :, None]
        self.least = np.square(np.maximum(np.maximum(under, over), 0).astype(self.kind))
        self.most = np.square(np.maximum(np.abs(under), np.abs(over)).astype(self.kind))

    def _open(self, cells: np.ndarray) -> list[np.ndarray]:
        """The entries that are not dominated, for each of the cells."""
        out = []
        for at in range(0, len(cells), 1024):
            c = cells[at : at + 1024]
            least, most = self.least[0][c[:, 0]], self.most[0][c[:, 0]]
            for d in range(1, c.shape[1]):
                least = least + self.least[d][c[:, d]]
                most = most + self.most[d][c[:, d]]
            rows, entries = np.nonzero((least <= most.min(1)[:, None]).astype(bool))
            out += np.split(entries, np.searchsorted(rows, np.arange(1, len(c))))
        return out

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of every row."""
        cells = ((x - self.grid.low) // self.grid.width).astype(np.uint8 if self.levels <= 256 else np.int64)
        keys = np.ascontiguousarray(cells).view(np.dtype((np.void, cells.dtype.itemsize * cells.shape[1]))).ravel()
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.memo) + len(distinct) > MEMO:
            self.memo, self.kept = {}, []
        names = [k.tobytes() for k in distinct]
        new = [i for i, k in enumerate(names) if k not in self.memo]
        for i, entries in zip(new, self._open(cells[first[new]]) if new else []):
            self.memo[names[i]] = len(self.kept)
            self.kept.append(entries)
        of_cell = [self.kept[self.memo[k]] for k in names]
        sizes = np.array([len(e) for e in of_cell])
        starts = np.cumsum(sizes) - sizes
        each = sizes[inverse]
        rows = np.repeat(np.arange(len(x)), each)
        begin = np.cumsum(each) - each
        entries = np.concatenate(of_cell)[np.arange(len(rows)) - np.repeat(begin - starts[inverse], each)]
        gap = x.astype(self.kind)[rows] - self.book[entries]
        gap *= gap
        far = gap.sum(1)
        best = np.minimum.reduceat(far, begin)
        wins = np.flatnonzero(far == best[rows])  # entries rise within a row, so the first one has the lowest index
        win = wins[np.searchsorted(wins, begin)]
        return entries[win], best


def parts_of(dim: int, parts: int) -> list[slice]:
    """Consecutive parts, equal where ``dim`` allows it, else the first ones longer by one."""
    ends = np.cumsum([len(p) for p in np.array_split(np.arange(dim), parts)])
    return [slice(int(a), int(b)) for a, b in zip([0, *ends[:-1]], ends) if b > a]


def _range(points: DataFrame, dim: int) -> tuple[list[int], list[int]]:
    """Smallest and largest number in every dimension."""

    def run(batches):
        lo, hi = None, None
        for _, x in chunks(batches, dim):
            lo = x.min(0) if lo is None else np.minimum(lo, x.min(0))
            hi = x.max(0) if hi is None else np.maximum(hi, x.max(0))
        if lo is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(dim), pa.int32()), "lo": lo, "hi": hi})

    rows = points.select("x").mapInArrow(run, "at int, lo long, hi long").groupBy("at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("at").collect()
    return [r["lo"] for r in rows], [r["hi"] for r in rows]


def _means(points: DataFrame, dim: int, books: list[np.ndarray], grid: Grid, levels: int) -> list[np.ndarray]:
    """Every entry replaced by the floor of the mean of its parts. A task sends one row for each sum of an entry that it met."""
    at = parts_of(dim, len(books))

    def run(batches):
        nearest = [Nearest(book, grid.part(p), levels) for book, p in zip(books, at)]
        rows = [np.zeros(len(book), np.int64) for book in books]
        sums = [(np.zeros(book.shape, np.int64), np.zeros(book.shape, np.int64)) for book in books]
        for _, x in chunks(batches, dim):
            for p, cut in enumerate(at):
                index, _ = nearest[p].find(x[:, cut])
                np.add.at(rows[p], index, 1)
                np.add.at(sums[p][0], index, x[:, cut] >> 20)
                np.add.at(sums[p][1], index, x[:, cut] & ((1 << 20) - 1))
        for p, cut in enumerate(at):
            met = np.flatnonzero(rows[p])
            width = cut.stop - cut.start
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(len(met) * width, p), pa.int32()),
                "entry": pa.array(np.repeat(met, width), pa.int32()),
                "place": pa.array(np.tile(np.arange(width), len(met)), pa.int32()),
                "n": np.repeat(rows[p][met], width),
                "high": sums[p][0][met].ravel(),
                "low": sums[p][1][met].ravel(),
            })

    partial = points.select("x").mapInArrow(run, "part int, entry int, place int, n long, high long, low long")
    totals = partial.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), exact_total("high", "low").alias("s"))
    out = [book.copy() for book in books]
    for r in totals.collect():  # one row for each number in the codebooks
        out[r["part"]][r["entry"], r["place"]] = int(r["s"]) // r["n"]
    return out


def _coded(points: DataFrame, dim: int, books: list[np.ndarray], grid: Grid, levels: int, kinds: str) -> DataFrame:
    at = parts_of(dim, len(books))

    def run(batches):
        nearest = [Nearest(book, grid.part(p), levels) for book, p in zip(books, at)]
        for part, x in chunks(batches, dim):
            found = [nearest[p].find(x[:, cut]) for p, cut in enumerate(at)]
            codes = np.stack([index for index, _ in found], 1).astype(np.uint8)
            error = sum(far.astype(object if far.dtype == object else np.int64) for _, far in found)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id"),
                    part.column("label"),
                    pa.array([c.tobytes().hex() for c in codes]),
                    pa.array([int(e) if e < 1 << 63 else None for e in error] if error.dtype == object else error, pa.int64()),
                ],
                ["vec_id", "label", "code", "error"],
            )

    return points.mapInArrow(run, f"{kinds}, code string, error long")


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, factor: int = 1024, levels: int = 32) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each usable vector.

    Components become whole numbers floor(factor * x), and vectors are cut into ``parts``. A codebook starts as its part of the ``entries`` vectors of
    smallest vec_id. ``rounds`` times, all parts go to their nearest entry (squared distance, ties to the lower index) and entries become
    the floor of the mean of their parts; entries without parts stay. ``code`` has two hex digits a part, ``error`` the
    squared distances to the final entries, ``label_error`` their sum over a label (nulls are one label), and the digest is over the
    codebooks' numbers, comma-joined. ``levels`` is the number of grid cells per dimension (see ``Nearest``); it does not change any result.

    Null vectors, and those with a null or non-finite component or another length than most have (the longer of two) are left out. Rows
    without an id are encoded but start no entry; of rows with one id the smallest vector starts one. With fewer ids than ``entries``,
    codebooks are shorter. Repeated rows count each time. Without any id the first vectors in their own order start the entries. Empty tables give no rows. Sums beyond
    a long are null. Without a column ``label`` all rows have one label; further columns are ignored.
    """
    if entries > 256 or levels > 256:
        raise ValueError("an entry's index has two hex digits, and a cell's step one byte")
    spark = vectors.sparkSession
    place = scratch(spark)
    labelled = vectors if "label" in vectors.columns else vectors.withColumn("label", F.lit(None).cast("int"))
    kinds = f"vec_id {dict(labelled.dtypes)['vec_id']}, label {dict(labelled.dtypes)['label']}"
    points = whole(labelled, factor, "vec_id", "label")
    dim = usual_length(points)
    if not dim:
        return spark.createDataFrame([], f"vec_id {dict(labelled.dtypes)['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    points = place.cut(points.where(F.size("x") == dim), "whole")
    named = points.where("vec_id is not null").groupBy("vec_id").agg(F.min("x").alias("x"))
    first = named.orderBy("vec_id").limit(entries).collect() or points.select("x").orderBy("x").limit(entries).collect()
    start = np.array([r["x"] for r in first], np.int64)
    grid = Grid.over(*_range(points, dim), levels)
    books = [start[:, p].copy() for p in parts_of(dim, parts)]
    for _ in range(rounds):
        books = _means(points, dim, books, grid, levels)
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()
    coded = place.cut(_coded(points, dim, books, grid, levels, kinds), "coded")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = F.when((F.count("error") == F.count(F.lit(1))) & (total <= F.lit((1 << 63) - 1).cast("decimal(38,0)")), total).cast("long")
    sums = coded.groupBy("label").agg(fits.alias("label_error"), F.count(F.lit(1)).alias("n"))
    return lookup(coded, "label", sums, "n", "vec_id").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

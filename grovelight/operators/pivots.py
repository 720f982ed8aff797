"""Exact searches that look only where something near enough can be.

Some points are drawn as pivots, and every point belongs to the cell of its nearest pivot. A cell is a
shell: its points lie between two distances from the pivot. By the triangle inequality a row that is
``x`` from the pivot is at least ``x - outer`` and at least ``inner - x`` from all of them, so a row with
a bound on the distance it cares for skips every cell that cannot meet it. What is left is compared
in numpy: a task holds a group of rows and reads the blocks that they may have to look into one after
the other, so points are sent once a group. Nothing is approximate: a search without a bound compares all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import ship_package
from ..sources.scratch import Scratch
from . import tiles as t

MOST_PIVOTS = 1024
PACKET = 512  # rows that a task compares at once
COLUMNS = 2048  # with so many points
HELD = 1 << 18  # result rows a task gathers before it drops those that others beat
GROUP_BYTES = 8 << 20
MIN_GROUP = 64


@dataclass(frozen=True)
class PivotIndex:
    """``points`` has the rows with their ``cell`` and ``sub``, ``blocks`` the same packed: ``(cell, sub, ids, flat, more…)``.

    The arrays have one entry a cell: how near and how far its points lie, how many they are and in how many blocks. Up to ``gone`` points
    may have been taken out since; the shells stay true without them. Where ``reach`` is given, a row also looks into a cell within the reach of that cell's points.
    """

    centres: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    counts: np.ndarray
    subs: np.ndarray
    points: DataFrame
    more: tuple[str, ...]
    gone: int = 0
    reach: np.ndarray | None = None

    @property
    def blocks(self) -> DataFrame:
        return _packed(self.points, self.more)

    def with_column(self, values: DataFrame, name: str) -> "PivotIndex":
        """The same index whose blocks carry another column, given as ``(id, name)``."""
        return replace(self, points=self.points.join(values, "id"), more=(*self.more, name))

    def with_reach(self, reach: Column) -> "PivotIndex":
        """The same index with the largest ``reach`` of the points of each cell."""
        far = np.zeros(len(self.counts))
        for c in self.points.groupBy("cell").agg(F.max(reach).alias("reach")).collect():
            far[c["cell"]] = c["reach"]
        return replace(self, reach=far)

    def only(self, kept: DataFrame, gone: int) -> "PivotIndex":
        """The same index without the ``gone`` points that ``kept(id)`` leaves out."""
        return replace(self, points=self.points.join(kept, "id", "left_semi"), gone=self.gone + gone)


def _packed(placed: DataFrame, more: Sequence[str]) -> DataFrame:
    rows = placed.groupBy("cell", "sub").agg(F.collect_list(F.struct("id", "vec", *more)).alias("r"))
    return rows.select("cell", "sub", F.col("r.id").alias("ids"), F.flatten("r.vec").alias("flat"), *[F.col(f"r.{m}").alias(m) for m in more])


def shell(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds from below and above on the distances of rows to centres, allowing for rounding."""
    rough, slack = t.rough_square(rows, centres)
    return np.sqrt(np.maximum(rough - slack, 0.0)), np.sqrt(np.maximum(rough + slack, 0.0))


def _matrix(batch: pa.RecordBatch, column: str = "vec") -> np.ndarray:
    return np.asarray(batch.column(column).flatten()).reshape(batch.num_rows, -1)


def draw_pivots(points: DataFrame, n: int) -> np.ndarray:
    """About ``sqrt(n)`` different points, those with the smallest hashes; at most ``MOST_PIVOTS`` come to the driver."""
    wanted = min(MOST_PIVOTS, max(1, math.isqrt(n)))
    drawn = points.select("vec").orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    return np.unique(np.array([r["vec"] for r in drawn], float), axis=0) if drawn else np.zeros((0, 0))


def _with_cells(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows with their nearest pivot and bounds on its distance, a packet at a time: a table of rows by pivots is held several times."""
    for batch in _slices(batches):
        low, high = shell(_matrix(batch), centres)
        cell = high.argmin(1)
        at = np.arange(len(cell))
        extra = [pa.array(cell, pa.int32()), pa.array(low[at, cell]), pa.array(high[at, cell])]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "cell", "_low", "_high"])


def build(
    points: DataFrame, scratch: Scratch, more: Sequence[str] = (), keep: int = 0, n: int | None = None, centres: np.ndarray | None = None
) -> PivotIndex:
    """Index of ``(id, vec, more…)``: one pass to place the points, one row a cell to the driver.

    The number of points and the pivots may be given where they are known: any pivots give right results, near ones fewer comparisons.
    ``keep`` is passed on to ``Scratch.cut``.
    """
    ship_package(points.sparkSession)
    more = tuple(more)
    rows = points.select("id", "vec", *more)
    n = rows.count() if n is None else n
    centres = draw_pivots(rows, n) if centres is None else centres

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _with_cells(batches, centres)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = scratch.cut(rows.mapInArrow(place, f"{kinds}, cell int, _low double, _high double"), "index", keep)
    cells = placed.groupBy("cell").agg(F.min("_low").alias("inner"), F.max("_high").alias("outer"), F.count(F.lit(1)).alias("n")).collect()
    inner, outer, counts = np.full(len(centres), np.inf), np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64)
    for c in cells:
        inner[c["cell"]], outer[c["cell"]], counts[c["cell"]] = c["inner"], c["outer"], c["n"]
    subs = -(-counts // t.ROWS_PER_BLOCK)
    sizes = F.create_map(*[F.lit(int(v)) for c in cells for v in (c["cell"], subs[c["cell"]])]) if cells else None
    sub = F.pmod(F.xxhash64("id"), sizes[F.col("cell")]).cast("int") if cells else F.lit(0)
    return PivotIndex(centres, inner, outer, counts, subs, placed.withColumn("sub", sub).drop("_low", "_high"), more)


def _reach_of(high: np.ndarray, outer: np.ndarray, counts: np.ndarray, wanted: int) -> np.ndarray:
    """For every row a distance within which at least ``wanted`` points lie: whole cells are taken, the one that ends nearest first."""
    reach = high + outer
    order = np.argsort(reach, axis=1)
    got = np.cumsum(counts[order], axis=1)
    enough = got >= wanted
    at = np.arange(len(high))
    return np.where(enough[:, -1], reach[at, order[at, enough.argmax(1)]], np.inf)


def _groups(index: PivotIndex, cores: int, asking: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """How rows that ask are grouped by their cell: the first group of a cell, the groups that share it, and the groups in all.

    Small cells that follow each other form a group, a large one is dealt over several. Every group gets the blocks it has to look into
    sent once, never through the driver, so groups are few: some for every core, and no more rows than ``GROUP_BYTES`` hold.
    """
    total = int(index.counts.sum())
    asking = total if asking is None else asking
    fits = max(1, GROUP_BYTES // (8 * (index.centres.shape[1] + 2)))
    size = max(1, min(fits, max(MIN_GROUP, -(-asking // (3 * cores)))))
    size = min(size * max(1, total // max(asking, 1)), 8 * max(size, fits))  # counted in points of the index
    first, parts = np.zeros(len(index.counts), np.int64), np.ones(len(index.counts), np.int64)
    group, held = 0, 0
    for cell, n in enumerate(index.counts.tolist()):
        if held and held + n > size:
            group, held = group + 1, 0
        first[cell], parts[cell] = group, max(1, -(-n // size))
        held += n
        if n > size:
            group, held = group + int(parts[cell]), 0
    return first, parts, group + 1


class _Placed:
    """Rows of a batch with their groups, bounds and the cells they may have to look into; made in the tasks."""

    def __init__(self, index: PivotIndex, cores: int, wanted: int | None, asking: int | None):
        self.held = np.flatnonzero(index.subs)
        self.centres, self.inner, self.outer, self.counts = (x[self.held] for x in (index.centres, index.inner, index.outer, index.counts))
        self.reach = None if index.reach is None else index.reach[self.held]
        self.first, self.parts, self.groups = _groups(index, cores, asking)
        self.wanted = wanted + index.gone if wanted else None

    def bounds(self, batch: pa.RecordBatch, high: np.ndarray) -> np.ndarray:
        return _reach_of(high, self.outer, self.counts, self.wanted) if self.wanted else np.asarray(batch.column("bound"))

    def group_of(self, batch: pa.RecordBatch, high: np.ndarray) -> np.ndarray:
        cell = self.held[high.argmin(1)]
        return self.first[cell] + np.arange(batch.num_rows) % self.parts[cell]

    def meets(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray, places: np.ndarray | slice = slice(None)) -> np.ndarray:
        limit = bound[:, None] if self.reach is None else np.maximum(bound[:, None], self.reach[places])
        return np.maximum(low - self.outer[places], self.inner[places] - high) <= limit


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, PACKET):
            yield whole.slice(at, PACKET)


def route(index: PivotIndex, asked: DataFrame, carried: Sequence[str] = (), wanted: int | None = None, asking: int | None = None) -> DataFrame:
    """``(grp, cell, near, l_ids)``: the rows of a group that have to look into a cell, and how near its pivot is to one of them.

    ``asked`` is ``(id, vec, bound, carried…)``. With ``wanted`` there is no column ``bound``: a row's bound is a distance
    that is sure to hold as many points.
    """
    placed = _Placed(index, asked.sparkSession.sparkContext.defaultParallelism, wanted, asking)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            low, high = shell(_matrix(batch), placed.centres)
            group = placed.group_of(batch, high)
            meets = placed.meets(low, high, placed.bounds(batch, high))
            order = np.argsort(group, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                row, place = np.nonzero(meets[rows].T)[::-1]
                if not len(row):
                    continue
                places, starts = np.unique(place, return_index=True)
                offsets = pa.array(np.append(starts, len(row)), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, batch.column("id").take(pa.array(rows[row])))
                near = np.minimum.reduceat(low[rows[row], place], starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(places), group[rows[0]]), pa.int32()), pa.array(placed.held[places], pa.int32()), pa.array(near), ids],
                    ["grp", "cell", "near", "l_ids"],
                )

    fields = [*([] if wanted else ["bound"])]
    return asked.select("id", "vec", *fields).mapInArrow(run, f"grp int, cell int, near double, l_ids array<{dict(asked.dtypes)['id']}>")


def _grouped(index: PivotIndex, asked: DataFrame, carried: Sequence[str], wanted: int | None, asking: int | None) -> DataFrame:
    """The rows that ask with their bounds, packed by group: ``(grp, l_ids, l_flat, l_bound, l_…)``, several rows a group."""
    placed = _Placed(index, asked.sparkSession.sparkContext.defaultParallelism, wanted, asking)
    fields = [*([] if wanted else ["bound"]), *carried]
    kinds = dict(asked.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            vec = _matrix(batch)
            _, high = shell(vec, placed.centres)
            group = placed.group_of(batch, high)
            order = np.argsort(group, kind="stable")
            columns = {"id": batch.column("id"), "bound": pa.array(placed.bounds(batch, high))} | {c: batch.column(c) for c in carried}
            starts = np.append(0, np.flatnonzero(np.diff(group[order])) + 1)
            offsets = np.append(starts, len(order))
            packed = {c: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), v.take(pa.array(order))) for c, v in columns.items()}
            flat = pa.ListArray.from_arrays(pa.array(offsets * vec.shape[1], pa.int32()), pa.array(vec[order].ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[order[starts]], pa.int32()), packed["id"], flat, packed["bound"], *[packed[c] for c in carried]],
                ["grp", "l_ids", "l_flat", "l_bound", *[f"l_{c}" for c in carried]],
            )

    schema = f"grp int, l_ids array<{kinds['id']}>, l_flat array<double>, l_bound array<double>" + "".join(f", l_{c} array<{kinds[c]}>" for c in carried)
    return asked.select("id", "vec", *fields).mapInArrow(run, schema)


def search(
    index: PivotIndex,
    asked: DataFrame,
    kernel: Callable[[t.Block, t.Block], dict[str, np.ndarray]],
    schema: str,
    carried: Sequence[str] = (),
    wanted: int | None = None,
    best: tuple[int, Sequence[str]] | None = None,
    asking: int | None = None,
) -> DataFrame:
    """Apply ``kernel(rows, points)`` to rows that ask and to the points they may have to look at; it returns columns of equal length.

    A task gets a group of rows and then, nearest first, the blocks that one of them has to look into, a few at a time. With ``best``
    (a number and the columns to order by, a distance first) it keeps so many results a row, and a row that has them looks no further than
    the last of them; the kernel then returns the place of the row as ``_row`` too. ``asking`` is the number of rows, where it is not
    that of the points.
    """
    spark = asked.sparkSession
    if not index.subs.any():
        return spark.createDataFrame([], schema)
    placed = _Placed(index, spark.sparkContext.defaultParallelism, wanted, asking)
    left_more, right_more = ["bound", *carried], list(index.more)
    block = index.blocks.select("cell", "sub", F.col("ids").alias("r_ids"), F.col("flat").alias("r_flat"), *[F.col(m).alias(f"r_{m}") for m in right_more])
    met = route(index, asked, carried, wanted, asking).groupBy("grp", "cell").agg(F.min("near").alias("near"))
    first = _grouped(index, asked, carried, wanted, asking).withColumn("kind", F.lit(0))
    both = first.unionByName(met.join(block, "cell").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartitionById(placed.groups, F.col("grp")).sortWithinPartitions("grp", "kind", "near", "cell", "sub")

    def side(found: list[dict], prefix: str, more: Sequence[str]) -> t.Block:
        ids = np.concatenate([f[f"{prefix}_ids"] for f in found])
        flat = np.concatenate([f[f"{prefix}_flat"] for f in found])
        return t.Block(ids, flat.reshape(len(ids), -1), {m: np.concatenate([f[f"{prefix}_{m}"] for f in found]) for m in more})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: t.Block | None = None
        group, waiting, packets, held, kept, fresh = None, [], [], [], 0, 0

        def merged() -> None:
            nonlocal held, kept, fresh
            if best is None or not fresh:
                return
            out = {name: np.concatenate([h[name] for h in held]) for name in held[0]}
            k, order = best
            keep = t.keep_k(out["_row"], [out[c] for c in order], k)
            out = {name: v[keep] for name, v in out.items()}
            held, kept, fresh = [out], len(keep), 0
            at = np.flatnonzero(out["_row"][k - 1 :] == out["_row"][: len(keep) - k + 1]) if len(keep) >= k else np.empty(0, np.int64)
            full = out["_row"][at]
            rows.more["bound"][full] = np.minimum(rows.more["bound"][full], out[order[0]][at + k - 1])

        def compared() -> Iterator[pa.RecordBatch]:
            nonlocal packets, fresh
            if not packets:
                return
            points = side(packets, "r", right_more)
            places = np.searchsorted(placed.held, np.unique([p["cell"] for p in packets]))
            packets = []
            for at in range(0, len(rows.ids), PACKET):
                bound = rows.more["bound"][at : at + PACKET]
                low, high = shell(rows.vec[at : at + PACKET], placed.centres[places])
                some = at + np.flatnonzero(placed.meets(low, high, bound, places).any(1))
                if not len(some):
                    continue
                for start in range(0, len(points.ids), COLUMNS):
                    s = slice(start, start + COLUMNS)
                    part = t.Block(points.ids[s], points.vec[s], {m: v[s] for m, v in points.more.items()})
                    out = kernel(t.Block(rows.ids[some], rows.vec[some], {m: v[some] for m, v in rows.more.items()}), part)
                    if best is None:
                        if len(next(iter(out.values()))):
                            yield pa.RecordBatch.from_arrays([pa.array(v) for v in out.values()], list(out))
                        continue
                    out["_row"] = some[out["_row"]]
                    held.append(out)
                    fresh += len(out["_row"])
                    if fresh > max(HELD, kept):
                        merged()
            if fresh > kept // 4:
                merged()

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal rows, held, kept, fresh
            if rows is not None:
                yield from compared()
                merged()
                if held and kept:
                    yield pa.RecordBatch.from_arrays([pa.array(v) for c, v in held[0].items() if c != "_row"], [c for c in held[0] if c != "_row"])
            rows, held, kept, fresh = None, [], 0, 0

        def gathered() -> None:
            nonlocal rows, waiting
            rows = side(waiting, "l", left_more)
            waiting = []

        size = 0
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            groups, kinds, cells = (columns[c].to_pylist() for c in ("grp", "kind", "cell"))
            for row in range(batch.num_rows):
                if groups[row] != group:
                    yield from ended()
                    group, size = groups[row], 0
                prefix, more = ("l", left_more) if kinds[row] == 0 else ("r", right_more)
                found = {f"{prefix}_{m}": t._numbers(columns[f"{prefix}_{m}"], row) for m in ("ids", "flat", *more)}
                if kinds[row] == 0:
                    waiting.append(found)
                    continue
                if waiting:
                    gathered()
                packets.append(found | {"cell": cells[row]})
                size += len(found["r_ids"])
                if size >= COLUMNS:
                    yield from compared()
                    size = 0
        waiting = []
        yield from ended()

    return dealt.mapInArrow(work, schema)


def _nearest_kernel(k: int, include_self: bool) -> Callable[[t.Block, t.Block], dict[str, np.ndarray]]:
    def kernel(rows: t.Block, block: t.Block) -> dict[str, np.ndarray]:
        rough, slack = t.rough_square(rows.vec, block.vec)
        if not include_self:
            t.leave_out_same(rough, rows.ids, block.ids)
        bound = rows.more["bound"]
        r, c = t.smallest_within(rough, k, 2 * slack, bound * bound + 2 * slack)
        d = np.sqrt(t.exact_square_pairs(rows.vec[r], block.vec[c]))
        near = d <= bound[r]
        r, c, d = r[near], c[near], d[near]
        return {"_row": r, "i": rows.ids[r], "j": block.ids[c], "d": d}

    return kernel


def nearest(points: DataFrame, k: int, include_self: bool = False, index: PivotIndex | None = None) -> DataFrame:
    """The k nearest points of every point: ``(i, j, d, rank)``, ties broken by the lower id.

    A row looks into the cells that begin within the distance that is sure to hold its k points.
    """
    index = index or build(points, Scratch(points.sparkSession))
    schema = f"i {dict(points.dtypes)['id']}, j {dict(points.dtypes)['id']}, d double"
    found = search(index, points.select("id", "vec"), _nearest_kernel(k, include_self), schema, wanted=k if include_self else k + 1, best=(k, ("d", "j")))
    order = W.partitionBy("i").orderBy("d", "j")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_graph(points: DataFrame, k: int, include_self: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """The k nearest points of every point: ``(*by, i, j, d, rank)``, ties broken by the lower id.

    A whole table is searched through its pivots. Groups are samples and runs, and each is compared in tiles.
    """
    return t.nearest_in_groups(points, k, by, include_self) if by else nearest(points, k, include_self)


def nearest_within(points: DataFrame, threshold: float, index: PivotIndex | None = None) -> DataFrame:
    """``(i, j, d)``: every row ``i`` with its nearest row ``j`` of lower id, where that is nearer than ``threshold``; ties to the lowest id."""
    index = index or build(points, Scratch(points.sparkSession))

    def kernel(rows: t.Block, block: t.Block) -> dict[str, np.ndarray]:
        rough, slack = t.rough_square(rows.vec, block.vec)
        rough[block.ids[None, :] >= rows.ids[:, None]] = np.inf
        bound = rows.more["bound"]
        r, c = t.smallest_within(rough, 1, 2 * slack, bound * bound + 2 * slack)
        d = np.sqrt(t.exact_square_pairs(rows.vec[r], block.vec[c]))
        near = (d < threshold) & (d <= bound[r])
        r, c, d = r[near], c[near], d[near]
        return {"_row": r, "i": rows.ids[r], "j": block.ids[c], "d": d}

    kind = dict(points.dtypes)["id"]
    found = search(index, points.select("id", "vec", F.lit(float(threshold)).alias("bound")), kernel, f"i {kind}, j {kind}, d double", best=(1, ("d", "j")))
    return found.groupBy("i").agg(F.min(F.struct("d", "j")).alias("b")).select("i", "b.j", "b.d")


def pairs_within(points: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(i, j, d)`` with ``i < j`` at most ``threshold`` apart."""
    index = build(points, Scratch(points.sparkSession))

    def kernel(rows: t.Block, block: t.Block) -> dict[str, np.ndarray]:
        rough, slack = t.rough_square(rows.vec, block.vec)
        r, c = np.nonzero((rough <= threshold * threshold + 2 * slack) & (rows.ids[:, None] < block.ids[None, :]))
        d = np.sqrt(t.exact_square_pairs(rows.vec[r], block.vec[c]))
        near = d <= threshold
        return {"i": rows.ids[r[near]], "j": block.ids[c[near]], "d": d[near]}

    kind = dict(points.dtypes)["id"]
    return search(index, points.select("id", "vec", F.lit(float(threshold)).alias("bound")), kernel, f"i {kind}, j {kind}, d double")

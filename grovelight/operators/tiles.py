"""Distances between all points of a table without holding them in one place.

Points are packed into blocks of bounded size by the hash of their id. A tile is a pair of blocks;
tiles are spread over the tasks and each one is a small numpy computation that returns only what the
operator needs (a row's local nearest points, one lightest edge per component, counts …), so memory
per task is one tile and the shuffle carries reduced rows. Blocks are dealt over partitions once and
every task reads the two partitions whose blocks it pairs, so no block is sent twice or goes through
the driver; only where there are many groups are blocks joined to tiles by group and number.

Distances are summed coordinate by coordinate, in the order the SQL expression uses: both give the
same bits, and equal vectors tie exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.numeric import square_distance
from ..session import ship_package

ROWS_PER_BLOCK = 1024
MIN_ROWS_PER_BLOCK = 32
SMALL_BYTES = 64 << 20
RANK_ROWS, RANK_COLUMNS = 256, 2048  # what a task compares at once when it counts
RANK_BLOCK_BYTES = 8 << 20  # large blocks: each is read once for every other one
FEW_GROUPS = 4  # of so many, tasks may read the blocks of other groups to no end
TASK_BYTES = 64 << 20  # of tiles that a task makes


@dataclass
class Block:
    """One side of a tile inside a task."""

    ids: np.ndarray
    vec: np.ndarray
    more: dict[str, np.ndarray]


def exact_square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``, summed in coordinate order."""
    total = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        gap = a[:, d, None] - b[None, :, d]
        gap *= gap
        total += gap
    return total


def exact_square_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of matching rows."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        gap = a[:, d] - b[:, d]
        total += gap * gap
    return total


def rough_square(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by one matrix product, and a bound on their error."""
    na, nb = (a * a).sum(1), (b * b).sum(1)
    one = np.ones
    # the norms are two more coordinates, so that nothing but the product passes over all pairs
    rough = np.column_stack([a, na, one(len(a))]) @ np.column_stack([-2.0 * b, one(len(b)), nb]).T
    scale = float(na.max(initial=0.0) + nb.max(initial=0.0))
    return rough, 1e-14 * (a.shape[1] + 8) * scale


@dataclass(frozen=True)
class Tiling:
    """How a table is cut: blocks per group, whether all blocks together are known to be small, groups and bytes."""

    blocks: int
    small: bool
    groups: int = 1
    size: int = 0

    def partitions(self, cores: int) -> int:
        """Over how many partitions blocks are dealt: tasks are pairs of them, some for each core, with no more tiles than ``TASK_BYTES`` hold."""
        made = self.size * self.blocks  # a block is half of a tile with each other one
        wanted = max(math.sqrt(8 * cores), math.sqrt(self.groups * made / TASK_BYTES), self.size / (TASK_BYTES / 2))
        return max(1, min(self.blocks * self.groups, math.ceil(wanted)))


def tiling_for(spark: SparkSession, n: int, groups: int, size_bytes: int, rows: int | None = None) -> Tiling:
    for_memory = math.ceil(n / (rows or ROWS_PER_BLOCK))
    for_cores = math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism / max(groups, 1)))
    blocks = max(1, for_memory, min(for_cores, math.ceil(n / MIN_ROWS_PER_BLOCK)))
    return Tiling(blocks, size_bytes <= SMALL_BYTES, groups, size_bytes)


def tiling_of(points: DataFrame, by: Sequence[str] = (), more: Sequence[str] = (), block_bytes: int = 0) -> Tiling:
    """Count rows and bytes once, and choose blocks from the largest group: of ``ROWS_PER_BLOCK`` rows, or more where
    ``block_bytes`` hold more."""
    arrays = [c for c in ("vec", *more) if isinstance(points.schema[c].dataType, T.ArrayType)]
    cells = sum((F.size(c) for c in arrays), F.lit(2 + len(more)))
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(cells).alias("cells")).agg(
        F.max("n").alias("n"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("groups"), F.sum("cells").alias("cells")
    )
    row = sizes.first()
    size, per_row = 8 * (row["cells"] or 0), 8 * (row["cells"] or 0) / max(row["all"] or 0, 1)
    rows = max(ROWS_PER_BLOCK, int(block_bytes / max(per_row, 1.0))) if block_bytes else None
    return tiling_for(points.sparkSession, row["n"] or 0, row["groups"], size, rows)


def _pack(points: DataFrame, by: Sequence[str], blocks: int, more: Sequence[str], partitions: int = 0) -> DataFrame:
    placed = points.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    keys = [*by, "_b"]
    if partitions:
        place = F.col("_b") + F.xxhash64(*by) if by else F.col("_b")
        placed = placed.withColumn("_place", F.pmod(place, F.lit(partitions)).cast("int")).repartitionById(partitions, F.col("_place"))
        keys.append("_place")
    rows = placed.groupBy(*keys).agg(F.collect_list(F.struct("id", "vec", *more)).alias("r"))
    return rows.select(*by, "_b", F.col("r.id").alias("ids"), F.flatten("r.vec").alias("flat"), *[F.col(f"r.{m}").alias(m) for m in more])


def tiles(points: DataFrame, by: Sequence[str] = (), more: Sequence[str] = (), tiling: Tiling | None = None) -> DataFrame:
    """One row per unordered pair of blocks, with the packed columns of both (``l_…`` and ``r_…``)."""
    spark = points.sparkSession
    by = list(by)
    tiling = tiling or tiling_of(points, by, more)
    blocks = tiling.blocks
    cores = spark.sparkContext.defaultParallelism
    carried = ["ids", "flat", *more]
    if tiling.groups <= FEW_GROUPS:
        packed = _pack(points, by, blocks, more, tiling.partitions(cores))
        left = packed.select(*by, F.col("_b").alias("_l"), *[F.col(c).alias(f"l_{c}") for c in carried])
        right = packed.select(*[F.col(c).alias(f"_right_{c}") for c in by], F.col("_b").alias("_r"), *[F.col(c).alias(f"r_{c}") for c in carried])
        met = F.col("_l") <= F.col("_r")
        for c in by:
            met &= F.col(c) == F.col(f"_right_{c}")
        return left.hint("shuffle_replicate_nl").join(right, met).drop(*[f"_right_{c}" for c in by])
    packed = _pack(points, by, blocks, more)
    tasks = max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    firsts = packed.select(*by, F.col("_b").alias("_l"))
    pairs = firsts.withColumn("_r", F.explode(F.sequence("_l", F.lit(blocks - 1)))).repartition(tasks, *by, "_l", "_r")
    left = packed.select(*by, F.col("_b").alias("_l"), *[F.col(c).alias(f"l_{c}") for c in carried])
    right = packed.select(*by, F.col("_b").alias("_r"), *[F.col(c).alias(f"r_{c}") for c in carried])
    if tiling.small:  # counted above
        left, right = F.broadcast(left), F.broadcast(right)
    return pairs.join(left, [*by, "_l"]).join(right, [*by, "_r"])


def _numbers(column: pa.Array, row: int) -> np.ndarray:
    values = column[row].values
    if isinstance(values, pa.ListArray):
        values = values.flatten()
    return np.asarray(values)


def run_tiles(
    tiled: DataFrame,
    kernel: Callable[[Block, Block, bool], dict[str, np.ndarray]],
    schema: str,
    by: Sequence[str] = (),
    more: Sequence[str] = (),
) -> DataFrame:
    """Apply ``kernel(left, right, same_block)`` to every tile; it returns columns of equal length."""
    ship_package(tiled.sparkSession)
    by, more = list(by), list(more)
    group_schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in tiled.select(*by).schema.fields) if by else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for row in range(batch.num_rows):
                def side(prefix: str) -> Block:
                    ids = _numbers(columns[f"{prefix}_ids"], row)
                    flat = _numbers(columns[f"{prefix}_flat"], row)
                    extra = {m: _numbers(columns[f"{prefix}_{m}"], row) for m in more}
                    return Block(ids, flat.reshape(len(ids), -1), extra)

                same = columns["_l"][row].as_py() == columns["_r"][row].as_py()
                left = side("l")
                out = kernel(left, left if same else side("r"), same)  # two reads of a block need not have its rows in the same order
                length = len(next(iter(out.values())))
                if not length:
                    continue
                arrays, names = [], []
                for g in by:
                    arrays.append(pa.repeat(columns[g][row], length))
                    names.append(g)
                for name, values in out.items():
                    arrays.append(pa.array(values))
                    names.append(name)
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return tiled.mapInArrow(work, group_schema + schema)


def both_ways(one_way: Callable[[Block, Block, bool], list[np.ndarray]], left: Block, right: Block, same: bool) -> list[np.ndarray]:
    """Run a directed kernel from left to right and, for different blocks, from right to left."""
    parts = one_way(left, right, same)
    if same:
        return parts
    return [np.concatenate(p) for p in zip(parts, one_way(right, left, False))]


def smallest_per_row(rough: np.ndarray, k: int, slack: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate positions per row: every entry that could be among the row's k smallest."""
    if rough.shape[1] <= k:
        keep = np.isfinite(rough)
    else:
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1]
        keep = (rough <= (limit + slack)[:, None]) & np.isfinite(rough)
    return np.nonzero(keep)


def smallest_within(rough: np.ndarray, k: int, slack: float, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidates of ``smallest_per_row`` that lie within their row's limit; rows with no more than k of those are not partitioned."""
    near = rough <= np.minimum(limit, np.finfo(float).max)[:, None]
    many = np.flatnonzero(np.count_nonzero(near, axis=1) > k)
    if len(many) and rough.shape[1] > k:
        some = rough[many]
        near[many] &= some <= (np.partition(some, k - 1, axis=1)[:, k - 1] + slack)[:, None]
    return np.divmod(np.flatnonzero(near), rough.shape[1])


def leave_out_same(rough: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
    """Set the entries of rows and columns with the same id to infinity."""
    both = np.flatnonzero(np.isin(rows, columns))
    if len(both):
        rough[both] = np.where(rows[both, None] == columns[None, :], np.inf, rough[both])


def keep_k(rows: np.ndarray, keys: Sequence[np.ndarray], k: int) -> np.ndarray:
    """Positions of the k first entries of each row, entries ordered by ``keys``."""
    order = np.lexsort((*reversed(keys), rows))
    sorted_rows = rows[order]
    first = np.searchsorted(sorted_rows, sorted_rows, side="left")
    return order[np.arange(len(order)) - first < k]


def all_pairs(points: DataFrame, by: Sequence[str] = (), second: str | None = None) -> DataFrame:
    """Every unordered pair once: ``(i, j, d)`` with ``i < j``; ``d2`` in the space ``second`` too."""
    more = [second] if second else []

    def kernel(left: Block, right: Block, same: bool) -> dict[str, np.ndarray]:
        a, b = np.meshgrid(np.arange(len(left.ids)), np.arange(len(right.ids)), indexing="ij")
        if same:
            keep = left.ids[:, None] < right.ids[None, :]
            a, b = a[keep], b[keep]
        else:
            a, b = a.ravel(), b.ravel()
        ia, ib = left.ids[a], right.ids[b]
        d = np.sqrt(exact_square(left.vec, right.vec)[a, b])
        out = {"i": np.minimum(ia, ib), "j": np.maximum(ia, ib), "d": d}
        if second:
            la = left.more[second].reshape(len(left.ids), -1)
            lb = right.more[second].reshape(len(right.ids), -1)
            out["d2"] = np.sqrt(exact_square(la, lb)[a, b])
        return out

    schema = "i long, j long, d double" + (", d2 double" if second else "")
    return run_tiles(tiles(points, by, more), kernel, schema, by, more)


def nearest_in_groups(points: DataFrame, k: int, by: Sequence[str], include_self: bool = False) -> DataFrame:
    """The k nearest points of every point among all of its group: ``(*by, i, j, d, rank)``, ties broken by the lower id."""

    def one_way(a: Block, b: Block, same: bool) -> list[np.ndarray]:
        rough, slack = rough_square(a.vec, b.vec)
        if same and not include_self:
            np.fill_diagonal(rough, np.inf)
        r, c = smallest_per_row(rough, k, 2 * slack)
        d = np.sqrt(exact_square_pairs(a.vec[r], b.vec[c]))
        best = keep_k(r, (d, b.ids[c]), k)
        return [a.ids[r[best]], b.ids[c[best]], d[best]]

    def kernel(left: Block, right: Block, same: bool) -> dict[str, np.ndarray]:
        i, j, d = both_ways(one_way, left, right, same)
        return {"i": i, "j": j, "d": d}

    local = run_tiles(tiles(points, by), kernel, "i long, j long, d double", by)
    order = W.partitionBy(*by, "i").orderBy("d", "j")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranks_of_pairs(points: DataFrame, pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The neighbour rank of ``j`` seen from ``i`` among all points, for a few ``j`` per ``i``.

    Every tile only counts how many of its points are nearer than each wanted one; no distance leaves
    the task. Blocks are as large as ``RANK_BLOCK_BYTES`` hold, since each is sent once for every other one.
    """
    by = list(by)
    here = points.select(*by, F.col("id").alias("i"), F.col("vec").alias("_vi"))
    there = points.select(*by, F.col("id").alias("j"), F.col("vec").alias("_vj"))
    square = square_distance(F.col("_vi"), F.col("_vj")).alias("limit")
    # measured once; a tile carries one number for each wanted pair, not a vector
    measured = pairs.select(*by, "i", "j").join(there, [*by, "j"]).join(here.distinct(), [*by, "i"]).select(*by, "i", "_vi", F.struct("j", square).alias("w"))
    wanted = measured.groupBy(*by, "i", "_vi").agg(F.collect_list("w").alias("w")).select(
        *by, F.col("i").alias("id"), F.col("_vi").alias("vec"), F.col("w.j").alias("want"), F.col("w.limit").alias("limit")
    )
    packed = points.join(wanted, [*by, "id", "vec"], "left").select(
        *by, "id", "vec",
        F.coalesce(F.size("want"), F.lit(0)).alias("n_want"),
        F.coalesce("want", F.array().cast("array<bigint>")).alias("want"),
        F.coalesce("limit", F.array().cast("array<double>")).alias("limit"),
    )
    more = ["n_want", "want", "limit"]

    def one_way(a: Block, b: Block, same: bool) -> list[np.ndarray]:
        per_row, want, limit = a.more["n_want"], a.more["want"], a.more["limit"]
        row = np.repeat(np.arange(len(a.ids)), per_row)
        counts = np.zeros(len(want), np.int64)
        starts = np.append(0, np.cumsum(per_row))
        nth = np.arange(len(want)) - starts[row]
        for lo in range(0, len(a.ids), RANK_ROWS):
            hi = min(lo + RANK_ROWS, len(a.ids))
            turns = [starts[lo] + np.flatnonzero(nth[starts[lo] : starts[hi]] == turn) for turn in range(int(per_row[lo:hi].max()))]
            for left in range(0, len(b.ids) if turns else 0, RANK_COLUMNS):
                ids = b.ids[left : left + RANK_COLUMNS]
                rough, slack = rough_square(a.vec[lo:hi], b.vec[left : left + RANK_COLUMNS])
                leave_out_same(rough, a.ids[lo:hi], ids)
                for at in turns:  # one wanted point of each row that has so many
                    r = row[at] - lo
                    held = rough if len(r) == hi - lo else rough[r]
                    sure = np.count_nonzero(held < (limit[at] - slack)[:, None], axis=1)
                    counts[at] += sure
                    some = np.flatnonzero(np.count_nonzero(held <= (limit[at] + slack)[:, None], axis=1) > sure)
                    if len(some):  # too near to call by a rounded product
                        part, lim = held[some], limit[at[some], None]
                        open_row, open_column = np.nonzero((part <= lim + slack) & ~(part < lim - slack))
                        open_row = some[open_row]
                        d = exact_square_pairs(a.vec[lo + r[open_row]], b.vec[left + open_column])
                        lim = limit[at[open_row]]
                        nearer = (d < lim) | ((d == lim) & (ids[open_column] < want[at[open_row]]))
                        counts[at] += np.bincount(open_row[nearer], minlength=len(at))
        return [a.ids[row], want, counts]

    def kernel(left: Block, right: Block, same: bool) -> dict[str, np.ndarray]:
        i, j, n = both_ways(one_way, left, right, same)
        return {"i": i, "j": j, "n": n}

    counted = run_tiles(tiles(packed, by, more, tiling_of(packed, by, more, RANK_BLOCK_BYTES)), kernel, "i long, j long, n long", by, more)
    return counted.groupBy(*by, "i", "j").agg((F.sum("n") + 1).alias("rank"))

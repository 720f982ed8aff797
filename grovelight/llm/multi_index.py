"""Approximate nearest neighbours: an inverted multi-index over two halves of the vectors."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import scratch

SHARDS = 16
BLOCK = 4096


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors as doubles; null and zero ones and those with a null, infinite or NaN component are left out."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", v.alias("v")).where("vec_id is not null and v is not null").where(finite & F.exists("v", lambda x: x != 0))


def codebooks(vectors: DataFrame, cells: int = 32, sample: int = 20_000, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Two sets of ``cells`` centroids by k-means on at most ``sample`` vectors, chosen by a hash of their contents.

    Vectors whose length differs from that of most of the sample take no part.
    """
    n = vectors.count()
    share = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) / float(1 << 30)
    drawn = vectors.select("v", share.alias("share")).where(F.col("share") < 2.0 * sample / max(n, 1)).orderBy("share", "v").limit(sample).collect()
    if not drawn:
        return np.zeros((0, 0)), np.zeros((0, 0))
    lengths, counts = np.unique([len(r["v"]) for r in drawn], return_counts=True)
    dim = int(lengths[counts.argmax()])
    points = np.unique(np.array([r["v"] for r in drawn if len(r["v"]) == dim]), axis=0)
    half = (dim + 1) // 2
    out = []
    for part in (points[:, :half], points[:, half:]):
        k = min(cells, len(part))
        centres = part[np.linspace(0, len(part) - 1, k).astype(int)].copy()
        for _ in range(rounds):
            near = nearest_centre(part, centres)
            for c in range(k):
                if (near == c).any():
                    centres[c] = part[near == c].mean(0)
        out.append(centres)
    return out[0], out[1]


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)


def traverse(first: np.ndarray, second: np.ndarray, held: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """Centroid pairs from the best sum on, until ``wanted`` vectors lie in the pairs visited.

    ``first`` and ``second`` are the query's inner products with the centroids of its halves, ``held`` the vectors per pair.
    The heap holds a frontier: a pair enters once both pairs before it, in either list, have been taken.
    """
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap = [(-(first[a[0]] + second[b[0]]), 0, 0)]
    done = np.zeros((len(a) + 1, len(b) + 1), bool)  # shifted by one: the border counts as taken
    done[0, :] = done[:, 0] = True
    out, got = [], 0
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        done[i + 1, j + 1] = True
        if held[a[i], b[j]]:
            out.append((int(a[i]), int(b[j])))
            got += held[a[i], b[j]]
        if i + 1 < len(a) and done[i + 2, j]:
            heapq.heappush(heap, (-(first[a[i + 1]] + second[b[j]]), i + 1, j))
        if j + 1 < len(b) and done[i, j + 2]:
            heapq.heappush(heap, (-(first[a[i]] + second[b[j + 1]]), i, j + 1))
    return out


def _coded(vectors: DataFrame, books: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Vectors of the index's length with the numbers of their two centroids."""
    half, dim = books[0].shape[1], books[0].shape[1] + books[1].shape[1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), dim)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("v"),
                    pa.array(nearest_centre(v[:, :half], books[0]), pa.int32()),
                    pa.array(nearest_centre(v[:, half:], books[1]), pa.int32()),
                ],
                ["vec_id", "v", "i", "j"],
            )

    return vectors.where(F.size("v") == dim).mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, v array<double>, i int, j int")


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def _plans(queries: DataFrame, books, held: np.ndarray, wanted: float) -> DataFrame:
    """For each query and shard of the index, the pairs to look into as a bit mask."""
    half, dim, cells = books[0].shape[1], books[0].shape[1] + books[1].shape[1], len(books[1])
    rows = -(-len(books[0]) // SHARDS)

    def run(batches):
        for batch in batches:
            ids, vecs, shards, masks = [], [], [], []
            if batch.num_rows:
                v = _matrix(batch.column("v"), dim)
                first, second = v[:, :half] @ books[0].T, v[:, half:] @ books[1].T
                for q in range(len(v)):
                    marks = np.zeros((SHARDS, rows * cells), bool)
                    for i, j in traverse(first[q], second[q], held, wanted):
                        marks[i % SHARDS, (i // SHARDS) * cells + j] = True
                    for s in np.flatnonzero(marks.any(1)):
                        ids.append(q)
                        shards.append(int(s))
                        masks.append(np.packbits(marks[s]).tobytes())
            take = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(take), batch.column("v").take(take), pa.array(shards, pa.int32()), pa.array(masks, pa.binary())],
                ["vec_id", "v", "shard", "mask"],
            )

    return queries.select("vec_id", "v").mapInArrow(run, f"vec_id {dict(queries.dtypes)['vec_id']}, v array<double>, shard int, mask binary")


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last, so that equal vectors always score the same."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _best_of_block(k: int, dim: int, cells: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table.column("mask").is_valid().to_numpy()
        ids = table.column("vec_id").to_numpy()
        v = _matrix(table.column("v").chunk(0), dim)
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        query, found, score = [], [], []
        if len(q) and len(m):
            local = (table.column("i").to_numpy()[m].astype(np.int64) // SHARDS) * cells + table.column("j").to_numpy()[m].astype(np.int64)
            for lo in range(0, len(q), 256):
                part = q[lo : lo + 256]
                masks = np.stack([np.unpackbits(np.frombuffer(table.column("mask")[int(x)].as_py(), np.uint8)) for x in part]).astype(bool)
                near = v[part] @ v[m].T
                near[~masks[:, local] | (ids[part][:, None] == ids[m][None, :])] = -np.inf
                keep = min(k, len(m))
                least = -np.partition(-near, keep - 1, axis=1)[:, keep - 1]
                slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
                rows, cols = np.nonzero((near >= (least - slack)[:, None]) & np.isfinite(near))
                exact = inner_products(v[part[rows]], v[m[cols]])
                order = np.lexsort((ids[m[cols]], -exact, rows))
                rows, cols, exact = rows[order], cols[order], exact[order]
                first = np.searchsorted(rows, np.arange(len(part)))
                top = np.arange(len(rows)) - first[rows] < k
                query.append(ids[part[rows[top]]])
                found.append(ids[m[cols[top]]])
                score.append(exact[top])
        both = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
        return pa.table({"query_id": both(query, pa.int64()), "vec_id": both(found, pa.int64()), "score": both(score, pa.float64())})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, cells: int = 32, visit: float = 0.6, sample: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query, ties to the smaller vec_id.

    Vectors are indexed under the pair of their halves' nearest centroids. A query takes pairs in the order of their summed inner
    products from a heap until they hold ``visit`` of all distinct vectors and more than ``k`` of them; everything in these pairs is scored exactly. Copies
    count once towards ``visit``, so a hot vector does not end the walk. Nothing is left out of a visited pair: pairs
    are dealt to shards and blocks of bounded size, each block returns its best, and the best of those are kept.

    ``vectors`` and ``queries`` have an integer vec_id and embedding. Queries are not their own neighbours (by vec_id). A repeated query is
    answered once; repeated rows of ``vectors`` are each listed. Unusable vectors (see ``usable``) take no part on either side; empty tables give no rows; further columns are ignored.
    """
    place = scratch(vectors.sparkSession)
    all_of = usable(vectors)
    books = codebooks(all_of, cells, sample)
    if not len(books[0]):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = len(books[1])
    dim = books[0].shape[1] + books[1].shape[1]
    coded = place.cut(_coded(all_of, books).withColumn("shard", F.col("i") % SHARDS), "coded")
    pairs = coded.groupBy("i", "j").agg(F.count_distinct(F.xxhash64("v")).alias("n")).collect()  # at most cells ** 2 rows
    held = np.zeros((len(books[0]), width), np.int64)
    for p in pairs:
        held[p["i"], p["j"]] = p["n"]
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = usable(queries).where(F.size("v") == dim).dropDuplicates(["vec_id", "v"]).repartition(parts, "vec_id")  # few bytes, much work
    n_queries = asked.count()
    blocks = coded.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).collect()  # one row a shard
    of_shard = F.element_at(F.create_map(*[F.lit(x) for b in blocks for x in (b["shard"], b["blocks"])]), F.col("shard"))
    runs = max(1, -(-n_queries // BLOCK))
    plans = _plans(asked, books, held, max(visit * held.sum(), k + 1)).where(of_shard.isNotNull())
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    hashed = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    left = plans.withColumn("block", each(of_shard)).withColumn("run", hashed(F.lit(runs))).select(
        "shard", "block", "run", "vec_id", "v", "mask", F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j")
    )
    right = coded.withColumn("block", hashed(of_shard)).withColumn("run", each(F.lit(runs))).select(
        "shard", "block", "run", "vec_id", "v", F.lit(None).cast("binary").alias("mask"), "i", "j"
    )
    best = left.unionByName(right).groupBy("shard", "block", "run").applyInArrow(
        _best_of_block(k, dim, width), "query_id long, vec_id long, score double"
    )
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

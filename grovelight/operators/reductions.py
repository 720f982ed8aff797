"""Text vectors, linear reduction, neighbour-graph weights and graph layouts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, HashingTF, RegexTokenizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import l2_normalize, square_distance
from ..functions.ordering import with_position
from ..session import ship_package
from ..sources.scratch import Scratch
from .pivots import build, knn_graph, nearest, search
from .tiles import Block, exact_square, exact_square_pairs, leave_out_same, rough_square

HALVINGS = 64
LEAST_EXPONENT = 745.2  # exp of less than minus this is zero as a double


def embed_text(
    df: DataFrame, column: str, dim: int = 256,
    batch_function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None,
) -> DataFrame:
    """``(id, vec)`` of unit length. Any batch function ``(id, text) -> (id, vec)`` can be plugged in;
    without one, hashed term counts weighted by inverse document frequency are used."""
    texts = df.select("id", F.coalesce(F.col(column), F.lit("")).alias("text"))
    if batch_function is not None:
        ship_package(df.sparkSession)
        vectors = texts.mapInPandas(batch_function, "id long, vec array<double>")
    else:
        words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"(?U)\W+").transform(texts)
        counts = HashingTF(inputCol="words", outputCol="tf", numFeatures=dim).transform(words)
        weighted = IDF(inputCol="tf", outputCol="v").fit(counts).transform(counts)
        vectors = weighted.select("id", vector_to_array("v").alias("vec"))
    return vectors.select("id", l2_normalize(F.col("vec")).alias("vec"))


def pca(points: DataFrame, k: int) -> DataFrame:
    """The first ``k`` principal components, centred; the largest loading of each is positive."""
    data = points.select("id", array_to_vector("vec").alias("raw"))
    centred = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(data).transform(data)
    model = PCA(k=k, inputCol="centred", outputCol="out").fit(centred)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    flips = F.array(*[F.lit(float(s) if s else 1.0) for s in signs])
    return model.transform(centred).select("id", F.zip_with(vector_to_array("out"), flips, lambda x, s: x * s).alias("vec"))


def knn_graph_approx(points: DataFrame, k: int, projections: int = 4, window: int = 512, seed: int = 67) -> DataFrame:
    """Approximate neighbours for tables too large for all tiles.

    Points are ordered along random directions and cut into overlapping runs of ``2 * window``
    points; neighbours are exact inside a run. Runs have the same length whatever the data looks
    like, so no cell is hot.
    """
    width = points.select(F.size("vec")).first()
    rng = np.random.default_rng(seed)
    tagged = None
    for number in range(projections):
        axis = rng.normal(size=width[0] if width else 1)
        along = F.aggregate(
            F.zip_with("vec", F.array(*[F.lit(float(a)) for a in axis]), lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x
        )
        placed = with_position(points.withColumn("_along", along), F.struct("_along", "id"), "_pos").drop("_along")
        part = placed.withColumn("projection", F.lit(number))
        tagged = part if tagged is None else tagged.unionByName(part)
    run = (F.col("_pos") / window).cast("long")
    runs = tagged.withColumn("run", F.explode(F.array(run, run - 1))).select("projection", "run", "id", "vec")
    runs = Scratch(points.sparkSession).cut(runs, "runs")
    found = knn_graph(runs, k, by=["projection", "run"]).select("i", "j", "d").distinct()
    order = W.partitionBy("i").orderBy("d", "j")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bisect(score: Callable[[np.ndarray, np.ndarray], np.ndarray], d: np.ndarray, target: float) -> np.ndarray:
    """The scale per row at which a falling or rising ``score(d, scale)`` meets the target; ``score`` must rise."""
    low, high = np.zeros(len(d)), np.full(len(d), np.inf)
    scale = np.ones(len(d))
    for _ in range(HALVINGS):
        too_big = score(d, scale) > target
        high = np.where(too_big, scale, high)
        low = np.where(too_big, low, scale)
        scale = np.where(np.isinf(high), low * 2, (low + high) / 2)
    return scale


def _neighbours(points: DataFrame, k: int, given: DataFrame | None) -> DataFrame:
    """``(i, j, d, rank)``: the first ``k`` of the given neighbours (exact or approximate), else the exact ones."""
    return knn_graph(points, k) if given is None else given.where(F.col("rank") <= k).select("i", "j", "d", "rank")


def _scaled(points: DataFrame, k: int, scale: Callable[[pd.Series], pd.Series], neighbours: DataFrame | None) -> DataFrame:
    """Neighbours with a per-row scale: ``(i, j, d, near, scale)``; a row has k neighbours at most."""
    ship_package(points.sparkSession)
    udf = F.pandas_udf(scale, "double")
    rows = _neighbours(points, k, neighbours).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("d", "j"))).alias("n"))
    scaled = rows.withColumn("ds", F.col("n.d")).withColumn("scale", udf("ds"))
    return scaled.select("i", "scale", F.element_at("ds", 1).alias("near"), F.explode("n").alias("e")).select(
        "i", "e.j", "e.d", "near", "scale"
    )


def _symmetric(edges: DataFrame) -> DataFrame:
    """Own and reversed weight of every directed edge: ``(i, j, a, b)``."""
    both = edges.select("i", "j", F.col("w").alias("a"), F.lit(0.0).alias("b")).unionByName(
        edges.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(0.0).alias("a"), F.col("w").alias("b"))
    )
    return both.groupBy("i", "j").agg(F.max("a").alias("a"), F.max("b").alias("b"))


def fuzzy_knn_graph(points: DataFrame, k: int = 10, neighbours: DataFrame | None = None) -> DataFrame:
    """Fuzzy neighbour weights ``(i, j, w)``: each row's scale makes its weights sum to ``log2(k)``,
    and both directions combine as ``a + b - a b``."""
    target = float(np.log2(k))

    def scale(rows: pd.Series) -> pd.Series:
        d = np.stack(rows.to_numpy())
        gap = np.maximum(d - d[:, :1], 0.0)
        return pd.Series(_bisect(lambda g, s: np.exp(-g / s[:, None]).sum(1), gap, target))

    gap = F.greatest(F.col("d") - F.col("near"), F.lit(0.0))
    edges = _scaled(points, k, scale, neighbours).select("i", "j", F.exp(-gap / F.col("scale")).alias("w"))
    return _symmetric(edges).select("i", "j", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("w"))


def perplexity_affinities(points: DataFrame, perplexity: float, neighbours: DataFrame | None = None) -> DataFrame:
    """Joint probabilities ``(i, j, p)`` whose rows have the wanted perplexity before symmetrising."""
    target = float(np.log(perplexity))

    def scale(rows: pd.Series) -> pd.Series:
        square = np.stack(rows.to_numpy()) ** 2
        square -= square[:, :1]

        def entropy(sq: np.ndarray, s: np.ndarray) -> np.ndarray:
            p = np.exp(-sq / s[:, None])
            total = p.sum(1)
            return np.log(total) + (sq / s[:, None] * p).sum(1) / total

        return pd.Series(_bisect(entropy, square, target))

    weight = F.exp((F.col("near") * F.col("near") - F.col("d") * F.col("d")) / F.col("scale"))
    edges = _scaled(points, int(3 * perplexity), scale, neighbours).select("i", "j", weight.alias("w"))
    total = edges.groupBy("i").agg(F.sum("w").alias("s"))
    conditional = edges.join(total, "i").select("i", "j", (F.col("w") / F.col("s")).alias("w"))
    n = points.agg(F.count(F.lit(1)).cast("double"))
    return _symmetric(conditional).select("i", "j", ((F.col("a") + F.col("b")) / (2 * n.scalar())).alias("p"))


def alpha_decay_operator(points: DataFrame, knn: int = 5, decay: float = 40, neighbours: DataFrame | None = None) -> DataFrame:
    """Row-stochastic ``(i, j, w)`` from ``exp(-(d / eps_i)^decay)`` of all pairs with ``eps_i`` the distance of
    the knn-th neighbour, averaged over both directions.

    A pair has a row where its weight is more than zero as a double; ``neighbours`` only tell ``eps``. Points go through the pivots twice,
    once for the totals of the rows and once for the weights, and no pair is shuffled unless ids repeat.
    """
    scratch = Scratch(points.sparkSession)
    index = build(points, scratch)
    near = nearest(points, knn, index=index) if neighbours is None else _neighbours(points, knn, neighbours)
    scales = near.groupBy(F.col("i").alias("id")).agg(F.max("d").alias("eps"))
    ids = points.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    scales = scratch.cut(ids.join(scales, "id", "left").select("id", "times", F.coalesce("eps", F.lit(0.0)).alias("eps")), "eps")
    reach = LEAST_EXPONENT ** (1.0 / decay) * (1 + 1e-9)
    index = index.with_column(scales.select("id", "eps"), "eps")
    index = index.with_reach(reach * F.col("eps"))

    def weights(rows: Block, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rough, slack = rough_square(rows.vec, block.vec)
        leave_out_same(rough, rows.ids, block.ids)
        limit = reach * np.maximum(rows.more["eps"][:, None], block.more["eps"][None, :])
        r, c = np.nonzero(rough <= limit * limit + 2 * slack)
        if 8 * len(r) > rough.size:
            d = np.sqrt(exact_square(rows.vec, block.vec)[r, c])
        else:
            d = np.sqrt(exact_square_pairs(rows.vec[r], block.vec[c]))
        both = np.zeros(len(d))
        for eps in (rows.more["eps"][r], block.more["eps"][c]):
            has = eps > 0
            both[has] += np.exp(-np.power(d[has] / eps[has], float(decay)))
        some = both > 0
        return r[some], c[some], both[some] / 2

    def summed(rows: Block, block: Block) -> dict[str, np.ndarray]:
        r, _, w = weights(rows, block)
        held = np.unique(r)
        return {"i": rows.ids[held], "s": np.bincount(r, w, len(rows.ids))[held]}

    def shares(rows: Block, block: Block) -> dict[str, np.ndarray]:
        r, c, w = weights(rows, block)
        return {"i": rows.ids[r], "j": block.ids[c], "w": w / rows.more["s"][r]}

    kind = dict(points.dtypes)["id"]
    asked = points.select("id", "vec").join(scales, "id").withColumn("bound", reach * F.col("eps"))
    pairs = f"i {kind}, j {kind}, w double"
    if scales.where("times > 1").isEmpty():
        sums = search(index, asked, summed, f"i {kind}, s double", ["eps"]).groupBy(F.col("i").alias("id")).agg(F.sum("s").alias("s"))
        total = scratch.cut(scales.join(sums, "id", "left").select("id", (F.coalesce("s", F.lit(0.0)) + 1).alias("s")), "total")
        other = search(index, asked.join(total, "id"), shares, pairs, ["eps", "s"])
    else:  # a pair of ids counts once, however often they come
        once = search(index, asked.withColumn("s", F.lit(1.0)), shares, pairs, ["eps", "s"]).groupBy("i", "j").agg(F.max("w").alias("w"))
        once = scratch.cut(once, "weights")
        sums = once.groupBy(F.col("i").alias("id")).agg(F.sum("w").alias("s"))
        total = scratch.cut(scales.join(sums, "id", "left").select("id", (F.coalesce("s", F.lit(0.0)) + F.col("times")).alias("s")), "total")
        other = once.join(total.withColumnRenamed("id", "i"), "i").select("i", "j", (F.col("w") / F.col("s")).alias("w"))
    itself = points.select("id").join(total, "id").select(F.col("id").alias("i"), F.col("id").alias("j"), (1 / F.col("s")).alias("w"))
    return other.unionByName(itself)


def spectral_entropies(step: DataFrame, steps: int = 100) -> np.ndarray:
    """Von Neumann entropy of the powers 1 to ``steps`` of an operator ``(a, b, w)``: of its singular values to that power, as shares.

    The rows and their negatives together have mean zero, so the variances along their principal axes are the squared singular values.
    Only those, one for each column of the operator, come to the driver.
    """
    columns = _columns(step)
    if not columns:
        return np.zeros(steps)
    rows = _dense_rows(step, columns, 0.0)
    both = rows.unionByName(rows.select("id", F.transform("vec", lambda x: -x).alias("vec")))
    model = PCA(k=len(columns), inputCol="v", outputCol="out").fit(both.select(array_to_vector("vec").alias("v")))
    square = step.agg(F.sum(F.col("w") * F.col("w"))).first()[0]
    values = np.sqrt(np.maximum(model.explainedVariance.toArray(), 0.0) * square)
    values = values[values > 1e-7 * values.max(initial=0.0)]  # the rest is rounding
    out = np.zeros(steps)
    for t in range(1, steps + 1):
        share = (values / values.max()) ** t
        share = share[share > 0] / share.sum()
        out[t - 1] = -(share * np.log(share)).sum()
    return out


def knee(curve: np.ndarray) -> int:
    """Index of the point where two straight lines, one up to it and one from it on, fit the curve best; the first of equals."""
    x = np.arange(len(curve), dtype=float)

    def misfit(lo: int, hi: int) -> float:
        fit = np.polyfit(x[lo:hi], curve[lo:hi], 1)
        return float(((np.polyval(fit, x[lo:hi]) - curve[lo:hi]) ** 2).sum())

    tried = range(1, len(curve) - 1)
    return min(tried, key=lambda i: round(misfit(0, i + 1) + misfit(i, len(curve)), 12), default=0)


def _columns(cells: DataFrame) -> list[int]:
    """The landmarks that a table walks to, ascending: at most as many as were asked for."""
    return sorted(r["b"] for r in cells.select("b").distinct().collect())


def _dense_rows(cells: DataFrame, columns: list[int], empty: float) -> DataFrame:
    """``(id, vec)``: the rows of a landmark table, with ``empty`` where it has no cell."""
    rows = cells.groupBy(F.col("a").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"))
    filled = F.transform(F.lit(columns), lambda x: F.coalesce(F.try_element_at("m", x.cast(dict(cells.dtypes)["b"])), F.lit(empty)))
    return rows.select("id", filled.alias("vec"))


def power(step: DataFrame, t: int, scratch: Scratch) -> DataFrame:
    """The operator ``(a, b, w)`` applied ``t`` times, by squaring: about ``2 log2 t`` joins."""
    def after(x: DataFrame, y: DataFrame) -> DataFrame:
        onward = y.select(F.col("a").alias("b"), F.col("b").alias("z"), F.col("w").alias("w2"))
        return x.join(onward, "b").groupBy("a", F.col("z").alias("b")).agg(F.sum(F.col("w") * F.col("w2")).alias("w"))

    out = None
    while t:
        if t % 2:
            out = step if out is None else scratch.cut(after(out, step), "walk")
        t //= 2
        if t:
            step = scratch.cut(after(step, step), "square")
    return out


def potential_places(walk: DataFrame, k: int) -> DataFrame:
    """``(id, vec)``: coordinates of landmarks whose distances approximate those between the rows of ``-log(w + 1e-7)``.

    Classical scaling of Euclidean distances between rows is the principal components of the rows, so no table of distances is needed.
    """
    potentials = walk.select("a", "b", (-F.log(F.col("w") + 1e-7)).alias("w"))
    return pca(_dense_rows(potentials, _columns(walk), float(-np.log(1e-7))), k)


def diffusion_potential(points: DataFrame, operator: DataFrame, t: int | str = 5, landmarks: int = 100, k: int = 2, seed: int = 67) -> DataFrame:
    """Coordinates that keep potential distances of ``t`` random-walk steps.

    Points walk to landmarks (cluster centres) and landmarks among themselves. Landmarks are scaled by the principal components of
    their potentials; points get the mean position of the landmarks they walk to. With ``t="auto"`` the walk is as long as the knee
    of the entropies of the landmark operator's powers 1 to 100 says. A table with fewer different points than ``landmarks`` has as
    many landmarks as points; there have to be at least ``k``.
    """
    scratch = Scratch(points.sparkSession)
    data = points.select("id", array_to_vector("vec").alias("features"))
    home = scratch.cut(KMeans(k=landmarks, seed=seed, maxIter=10).fit(data).transform(data).select("id", F.col("prediction").alias("c")), "home")
    op = scratch.cut(operator, "operator")
    to_mark = op.join(home.withColumnRenamed("id", "j"), "j").groupBy("i", "c").agg(F.sum("w").alias("w"))
    to_mark = scratch.cut(to_mark, "to_mark")
    size = home.groupBy(F.col("c").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    seen = home.select(F.col("id").alias("i"), F.col("c").alias("a")).join(to_mark, "i").groupBy("a", F.col("c").alias("b")).agg(F.sum("w").alias("s"))
    step = scratch.cut(seen.join(size, "a").select("a", "b", (F.col("s") / F.col("n")).alias("w")), "step")
    steps = knee(spectral_entropies(step)) + 1 if t == "auto" else t
    walk = power(step, steps, scratch)
    marks = scratch.cut(potential_places(walk, k), "marks").select(F.col("id").alias("c"), F.col("vec").alias("y"))
    mixed = to_mark.join(F.broadcast(marks), "c").select("i", "w", F.posexplode("y").alias("axis", "y"))  # one row per landmark
    axes = mixed.groupBy("i").pivot("axis", list(range(k))).agg(F.sum(F.col("w") * F.col("y")))
    return axes.select(F.col("i").alias("id"), F.array(*[F.col(str(a)) for a in range(k)]).alias("vec"))


TURNS = 12
SPARE = 2  # draws beyond those wanted, before it is known whether they are needed


def _draws(rows: DataFrame, keys: list[str], n: int, count: int, seed: int, tag: str, start: int = 0) -> DataFrame:
    """``min(count, n)`` different pseudo-random positions below ``n`` per row, repeatable: adds ``nth`` and ``pos``; the first ``start`` are left out.

    Every row has its own permutation of the positions, and its draws are where the first ``count`` go. In each turn a position and
    its mirror image about a secret centre change places or stay, by a hash of the larger of the two; that is a permutation for every ``n``.
    The hashes are those of ``hashed``: the first 15 digits of an md5, whose last bit is one of its eighth byte. The centres are hashed once a row.
    """
    spark = rows.sparkSession
    ship_package(spark)

    def permuted(keyed: pd.Series) -> pd.Series:
        found = []
        for key in keyed:
            centres = [int.from_bytes(md5(f"{key}:{turn}".encode()).digest()[:8], "big") >> 4 for turn in range(TURNS)]
            places = []
            for pos in range(start, min(count, n)):
                for turn, centre in enumerate(centres):
                    mirror = (centre - pos) % n
                    if md5(f"{key}:{turn}:{max(pos, mirror)}".encode()).digest()[7] & 16:
                        pos = mirror
                places.append(pos)
            found.append(places)
        return pd.Series(found)

    # few bytes and much work: dealt over all cores, however few files the rows are in
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(f"{tag}:{seed}")))
    places = F.pandas_udf(permuted, "array<long>")(key)
    drawn = rows.repartition(tasks, *keys).withColumn("_places", places).select(*rows.columns, F.posexplode("_places").alias("nth", "pos"))
    return drawn.withColumn("nth", F.col("nth") + start)


def _local_scale(near: DataFrame) -> DataFrame:
    """Mean distance to the 4th to 6th neighbour; tiny rather than zero where those are copies."""
    return near.where("rank BETWEEN 4 AND 6").groupBy("i").agg(F.greatest(F.avg("d"), F.lit(1e-10)).alias("sigma"))


def _far_points(points: DataFrame, anchors: DataFrame, keys: list[str], near: DataFrame, k: int, count: int, seed: int, scratch: Scratch) -> DataFrame:
    """``count`` sampled points per anchor row that are neither the anchor nor its (at most ``k``) neighbours.

    As many spare positions may be drawn as can be taken away, so there are fewer only where fewer exist; ``SPARE`` at first, the
    others for the rows that those leave short."""
    places = scratch.cut(with_position(points.select("id"), F.col("id"), "pos"), "places")
    n = places.count()
    most, first = count + k + 1, count + min(SPARE, k + 1)

    def free(rows: DataFrame, start: int, end: int) -> DataFrame:
        drawn = _draws(rows, keys, n, end, seed, "far", start).join(places, "pos").withColumnRenamed("id", "far")
        return drawn.where("far <> i").join(near.select("i", F.col("j").alias("far")), ["i", "far"], "left_anti")

    drawn = scratch.cut(free(anchors, 0, first), "drawn")
    full = drawn.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= count)
    short = scratch.cut(anchors.join(full, keys, "left_anti"), "short")
    clean = drawn.unionByName(free(short, first, most))
    order = W.partitionBy(*keys).orderBy("nth")
    return clean.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= count).drop("_r", "nth", "pos")


def _with_distance(pairs: DataFrame, points: DataFrame, a: str, b: str, out: str) -> DataFrame:
    va = points.select(F.col("id").alias(a), F.col("vec").alias("_va"))
    vb = points.select(F.col("id").alias(b), F.col("vec").alias("_vb"))
    return pairs.join(va, a).join(vb, b).withColumn(out, F.sqrt(square_distance(F.col("_va"), F.col("_vb")))).drop("_va", "_vb")


def mine_triplets(points: DataFrame, n_in: int = 12, n_out: int = 4, n_rand: int = 3, seed: int = 67, neighbours: DataFrame | None = None) -> DataFrame:
    """``(anchor, near, far, weight)``: neighbours against sampled others, and random triplets."""
    scratch = Scratch(points.sparkSession)
    near = scratch.cut(_neighbours(points, max(n_in, 6), neighbours), "near")
    inner = near.where(F.col("rank") <= n_in).select("i", "j", "d")
    mined = _far_points(points, inner, ["i", "j"], near, max(n_in, 6), n_out, seed, scratch)
    anchors = points.select(F.col("id").alias("i"))
    loose = _far_points(points, anchors, ["i"], near, max(n_in, 6), 2 * n_rand, seed + 1, scratch)
    order = W.partitionBy("i").orderBy("far")
    halves = loose.withColumn("_r", F.row_number().over(order) - 1).withColumn("_t", (F.col("_r") / 2).cast("int"))
    paired = _with_distance(halves, points, "i", "far", "d").groupBy("i", "_t").agg(
        F.min(F.struct("d", "far")).alias("_lo"), F.max(F.struct("d", "far")).alias("_hi"), F.count(F.lit(1)).alias("_n")
    ).where("_n = 2").select("i", F.col("_lo.far").alias("j"), F.col("_lo.d").alias("d"), F.col("_hi.far").alias("far"))
    both = scratch.cut(_with_distance(mined.select("i", "j", "d", "far").unionByName(paired), points, "i", "far", "d_far"), "triplets")
    sigma = scratch.cut(_local_scale(near), "sigma")
    scaled = both
    for column, name in (("i", "s_i"), ("j", "s_j"), ("far", "s_far")):
        scaled = scaled.join(sigma.select(F.col("i").alias(column), F.col("sigma").alias(name)), column)
    gap = F.col("d_far") * F.col("d_far") / (F.col("s_i") * F.col("s_far")) - F.col("d") * F.col("d") / (F.col("s_i") * F.col("s_j"))
    gaps = scratch.cut(scaled.select("i", "j", "far", gap.alias("gap")), "gaps")
    least = gaps.agg(F.min("gap"))
    return gaps.withColumn("_least", least.scalar()).select(
        F.col("i").alias("anchor"), F.col("j").alias("near"), "far", F.log1p(F.col("gap") - F.col("_least")).alias("weight")
    )


def mine_pairs(points: DataFrame, n_near: int = 10, n_mid: int = 5, n_far: int = 20, seed: int = 67, extra: int = 50, neighbours: DataFrame | None = None) -> DataFrame:
    """``(i, j, kind)``: near pairs by scaled distance, mid pairs (second nearest of six), far pairs."""
    scratch = Scratch(points.sparkSession)
    near = scratch.cut(_neighbours(points, n_near + extra, neighbours), "near")
    sigma = scratch.cut(_local_scale(near), "sigma")
    scaled = near.join(sigma.withColumnRenamed("sigma", "s_i"), "i").join(sigma.select(F.col("i").alias("j"), F.col("sigma").alias("s_j")), "j")
    scaled = scaled.withColumn("q", F.col("d") * F.col("d") / (F.col("s_i") * F.col("s_j")))
    by_scale = W.partitionBy("i").orderBy("q", "j")
    close = scratch.cut(scaled.withColumn("_r", F.row_number().over(by_scale)).where(F.col("_r") <= n_near).select("i", "j"), "close")
    anchors = points.select(F.col("id").alias("i"))
    places = scratch.cut(with_position(points.select("id"), F.col("id"), "pos"), "places")
    tries = _draws(anchors, ["i"], places.count(), 6 * n_mid + 1, seed, "mid").join(places, "pos").withColumnRenamed("id", "j").where("i <> j")
    turn = F.row_number().over(W.partitionBy("i").orderBy("nth")) - 1  # the row itself may be among the tries
    tries = tries.withColumn("round", (turn / 6).cast("int")).where(F.col("round") < n_mid)
    tried = _with_distance(tries, points, "i", "j", "d")
    second = W.partitionBy("i", "round").orderBy("d", "j")
    mid = tried.withColumn("_r", F.row_number().over(second)).where("_r = 2").select("i", "j")
    far = _far_points(points, anchors, ["i"], close, n_near, n_far, seed, scratch).select("i", F.col("far").alias("j"))
    kinds = {"near": close, "mid": mid, "far": far}
    tables = [df.withColumn("kind", F.lit(kind)) for kind, df in kinds.items()]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def graph_layout(edges: DataFrame, start: DataFrame, epochs: int = 20, repulsions: int = 5, rate: float = 1.0, seed: int = 67) -> DataFrame:
    """Two coordinates per node of a weighted graph ``(i, j, w)``, from ``start(id, vec)``.

    Each epoch adds up the pull of a node's edges and the push of a few sampled nodes, each bounded,
    and moves it; the pull and push are those of the curve ``1 / (1 + r^2)``.
    """
    scratch = Scratch(start.sparkSession)
    placed = with_position(start.select("id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")), F.col("id"), "pos")
    spread = placed.agg(F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    scale = spread.select((F.lit(5.0) / F.greatest("sx", "sy", F.lit(1e-9))).alias("s"))
    state = scratch.cut(placed.withColumn("_s", scale.scalar()).select("id", "pos", (F.col("x") * F.col("_s")).alias("x"), (F.col("y") * F.col("_s")).alias("y")), "layout", keep=2)
    n = state.count()
    graph = scratch.cut(edges.select("i", "j", "w"), "graph")
    for epoch in range(epochs):
        here = state.select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
        there = state.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
        dx, dy = F.col("xj") - F.col("xi"), F.col("yj") - F.col("yi")
        r2 = dx * dx + dy * dy
        pull = 2 * F.col("w") / (1 + r2)
        pulled = graph.join(here, "i").join(there, "j").select("i", (pull * dx).alias("fx"), (pull * dy).alias("fy"))
        others = state.select(F.col("pos"), F.col("x").alias("xj"), F.col("y").alias("yj"))
        push = -F.lit(2.0) / ((F.lit(0.001) + r2) * (1 + r2))
        pushed = _draws(here, ["i"], n, repulsions, seed + epoch, "push").join(others, "pos").where(r2 > 0).select(
            "i", (push * dx).alias("fx"), (push * dy).alias("fy")
        )
        limit = lambda c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.col(c)))
        force = pulled.unionByName(pushed).groupBy(F.col("i").alias("id")).agg(F.sum(limit("fx")).alias("fx"), F.sum(limit("fy")).alias("fy"))
        step = rate * (1 - epoch / epochs) * 0.1
        moved = state.join(force, "id", "left").select(
            "id", "pos", (F.col("x") + step * F.coalesce("fx", F.lit(0.0))).alias("x"), (F.col("y") + step * F.coalesce("fy", F.lit(0.0))).alias("y")
        )
        state = scratch.cut(moved, "layout", keep=2)
    return state.select("id", F.array("x", "y").alias("vec"))


def reductions_table(points: DataFrame, reductions: Mapping[str, DataFrame]) -> DataFrame:
    """All reductions in one table; the vectors as they are form the method ``Raw``."""
    table = points.select(F.lit("Raw").alias("method"), "id", "vec")
    for method, df in reductions.items():
        table = table.unionByName(df.select(F.lit(method).alias("method"), "id", "vec"))
    return table

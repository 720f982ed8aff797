"""Diffusion potentials: walks, their scaling and their length."""

import numpy as np
import pytest

from grovelight.operators import reductions as rd
from grovelight.sources.scratch import Scratch


def cells(spark, p):
    rows = [(int(a) * 3, int(b) * 3, float(p[a, b])) for a, b in zip(*np.nonzero(p))]  # numbers with gaps
    return spark.createDataFrame(rows, "a long, b long, w double")


def dense(rows, n):
    out = np.zeros((n, n))
    for r in rows:
        out[r["a"] // 3, r["b"] // 3] = r["w"]
    return out


def stochastic(n, seed, keep=0.4):
    rng = np.random.default_rng(seed)
    p = rng.random((n, n)) * (rng.random((n, n)) < keep) + np.eye(n)
    return p / p.sum(1, keepdims=True)


@pytest.mark.parametrize("t", [1, 2, 5, 8, 11])
def test_powers(spark, t):
    p = stochastic(9, t)
    assert np.allclose(dense(rd.power(cells(spark, p), t, Scratch(spark)).collect(), 9), np.linalg.matrix_power(p, t), atol=1e-12)


def test_places_match_classical_scaling(spark):
    n, k = 14, 3
    p = stochastic(n, 3)
    u = -np.log(p + 1e-7)
    square = ((u[:, None] - u[None]) ** 2).sum(-1)
    middle = np.eye(n) - 1.0 / n
    values, vectors = np.linalg.eigh(-0.5 * middle @ square @ middle)
    want = vectors[:, ::-1][:, :k] * np.sqrt(values[::-1][:k])
    got = {r["id"] // 3: r["vec"] for r in rd.potential_places(cells(spark, p), k).collect()}
    got = np.array([got[i] for i in range(n)])
    apart = lambda x: np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.allclose(apart(got), apart(want), atol=1e-6)


def test_entropies_of_a_known_spectrum(spark):
    values = np.array([1.0, 0.9, 0.5, 0.2, 0.1])
    turn, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(5, 5)))
    for p in (np.diag(values), turn @ np.diag(values) @ turn.T[::-1]):
        got = rd.spectral_entropies(cells(spark, p), 30)
        for t in range(1, 31):
            share = values**t / (values**t).sum()
            assert got[t - 1] == pytest.approx(-(share * np.log(share)).sum(), abs=1e-6)


def test_knee_of_two_lines():
    assert rd.knee(np.array([10.0, 8, 6, 4, 2, 1.9, 1.8, 1.7, 1.6])) == 4
    assert rd.knee(np.zeros(20)) == 1 and rd.knee(np.zeros(1)) == 0


def test_walk_length_may_be_chosen(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c * 6, 1, (40, 3)) for c in range(3)])
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>").cache()
    op = rd.alpha_decay_operator(points, 5, 10)
    got = {r["id"]: r["vec"] for r in rd.diffusion_potential(points, op, t="auto", landmarks=12).collect()}
    y = np.array([got[i] for i in range(120)]).reshape(3, 40, 2)
    centres = y.mean(1)
    within = np.sqrt(((y - centres[:, None]) ** 2).sum(-1)).mean()
    between = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(-1))[np.triu_indices(3, 1)].min()
    assert between > 2 * within


def test_alpha_decay_weighs_all_partners(spark):
    """Against the whole kernel in numpy: partners beyond the knn-th count, in a dense and a sparse cloud, with copies and repeated ids."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(50, 3)), 40 + 0.1 * rng.normal(size=(40, 3)), np.full((7, 3), -30.0)])

    def whole(x, decay):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        eps = np.sort(d + np.diag(np.full(len(x), np.inf)), axis=1)[:, 4]
        a = np.array([np.exp(-((row / e) ** decay)) if e > 0 else np.zeros(len(x)) for row, e in zip(d, eps)])
        w = (a + a.T) / 2
        np.fill_diagonal(w, 1.0)
        return w, w / w.sum(1, keepdims=True)

    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    for decay in (10, 40):
        w, want = whole(x, decay)
        got = {(r["i"], r["j"]): r["w"] for r in rd.alpha_decay_operator(spark.createDataFrame(rows, "id long, vec array<double>"), 5, decay).collect()}
        assert got.keys() == {(int(i), int(j)) for i, j in zip(*np.nonzero(w))}
        assert len(got) > 97 * 11 and all(v == pytest.approx(want[k], rel=1e-9) for k, v in got.items())
    twice = spark.createDataFrame(rows[:50] + rows[:3], "id long, vec array<double>")
    got = rd.alpha_decay_operator(twice, 5, 10).collect()
    assert len({(r["i"], r["j"]) for r in got}) == len(got) - 3
    assert sum(r["w"] for r in got) == pytest.approx(50.0)

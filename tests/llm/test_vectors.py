"""Whitening and vector codes against numpy, Python numbers and exhaustive search."""

import hashlib
import math

import numpy as np
import pytest

from grovelight.llm import vector_codes, whitening
from grovelight.llm.spectrum import above, leading

SCHEMA = "vec_id long, embedding array<float>, label int, x int, n long, part int, code string, w0 double, error double"


def frame(spark, rows):
    """Rows (vec_id, embedding, label) with further columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(*r, 1, 2, 3, "c", 0.5, 0.5) for r in rows], SCHEMA).repartition(3)


def vectors(n=400, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, dim)) * np.linspace(2, 0.3, dim) + rng.normal(size=dim)
    return [(i, [float(np.float32(c)) for c in p], i % 3 if i % 7 else None) for i, p in enumerate(points)]


def awkward(rows):
    """Nulls, holes, odd lengths, repeated rows and ids, and a third of all rows in one copy."""
    hot = [(1000 + i, rows[0][1], 5) for i in range(len(rows) // 2)]
    bad = [(5001, None, 1), (5002, [None] + rows[0][1][1:], 1), (5003, [math.nan] + rows[0][1][1:], 1), (5004, [math.inf] + rows[0][1][1:], None), (5005, [1.0, 2.0], 1), (5006, [], 1)]
    return rows + hot + bad + [rows[3], (rows[3][0], rows[4][1], 2), (None, rows[5][1], None), (None, rows[6][1], 2)]


def usable(rows, dim):
    return [r for r in rows if r[1] is not None and len(r[1]) == dim and all(c is not None and math.isfinite(c) for c in r[1])]


def test_counts_above_a_shift_match_the_eigenvalues():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 24):
        a = rng.normal(size=(d, d))
        a = (a + a.T) / 2
        known = np.linalg.eigvalsh(a)
        for shift in [0.0, *((known[1:] + known[:-1]) / 2), known[0] - 1, known[-1] + 1]:
            assert above(a, shift) == (known > shift).sum()
    assert above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1  # no single pivot would do
    assert above(np.zeros((3, 3)), 0.0) == 0


@pytest.mark.parametrize("spectrum", [
    [9, 7, 4, 1, 0.5, 0.1], [5, 5, 5, 1, 1, 0], [3, 3 - 1e-9, 3 - 2e-9, 1, 1, 1], [1, 1, 1, 1, 1, 1], [1e12, 1, 1e-3, 0, 0, 0], [2, 1.99999, 1.9999, 1.999, 1.99, 1.9], [0] * 6,
])
def test_leading_pairs_match_the_known_spectrum(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(7).normal(size=(6, 6)))
    matrix = (q * spectrum) @ q.T
    values, axes = leading(matrix, 4)
    scale = max(max(spectrum), 1e-300)
    np.testing.assert_allclose(values / scale, np.array(sorted(spectrum, reverse=True)[:4]) / scale, atol=1e-14)
    np.testing.assert_allclose(axes @ axes.T, np.eye(4), atol=1e-10)
    assert np.abs(matrix @ axes.T - axes.T * values).max() <= 1e-13 * scale


def test_whitened_vectors_match_numpy(spark):
    rows = awkward(vectors())
    got = whitening.whiten(frame(spark, rows)).collect()
    kept = usable(rows, 8)
    x = np.array([[math.floor(256 * c) for c in v] for _, v, _ in kept])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    assert len(got) == 4 * len(kept) and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1
    w = (x - sums / n) @ axes / np.sqrt(values)
    deviation = ((n * x - sums) ** 2).sum(1)
    expected = {}
    for (vec_id, _, _), row, dev in zip(kept, w, deviation):
        expected.setdefault(vec_id, []).append((int(dev), row))
    sign = {}
    for c in range(4):
        mine = next(r for r in got if r["vec_id"] == 17 and r["component"] == c + 1)
        sign[c + 1] = 1 if mine["whitened"] * expected[17][0][1][c] > 0 else -1
    for r in got:
        c = r["component"]
        near = [abs(sign[c] * r["whitened"] - row[c - 1]) for dev, row in expected[r["vec_id"]] if dev == r["deviation"]]
        assert min(near) < 1e-9
        assert r["explained"] == pytest.approx(values[c - 1] / np.cov(fit.T, bias=True).trace(), rel=1e-10)


def test_whitening_of_little(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None, 1), (2, [math.nan], 1)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).count() == 0  # no variance, no direction
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i, 0.0], 1) for i in range(5)])).collect()
    assert {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1.0)
    huge = whitening.whiten(frame(spark, [(i, [1e30 * (i % 2), float(i)], 1) for i in range(4)])).collect()
    assert {r["deviation"] for r in huge} == {None}


def brute_codes(rows, dim, parts=4, entries=256, rounds=4):
    kept = usable(rows, dim)
    x = [[math.floor(1024 * c) for c in v] for _, v, _ in kept]
    width = dim // parts
    least = {}
    for (vec_id, _, _), v in zip(kept, x):
        if vec_id is not None:
            least[vec_id] = min(least.get(vec_id, v), v)
    first = [least[i] for i in sorted(least)[:entries]]
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]

    def near(book, q):
        return min((sum((a - b) ** 2 for a, b in zip(q, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for v in x:
                q = v[p * width : (p + 1) * width]
                groups.setdefault(near(book, q)[1], []).append(q)
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(book)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    found = [[near(book, v[p * width : (p + 1) * width]) for p, book in enumerate(books)] for v in x]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], digest) for (i, _, label), f, e in zip(kept, found, errors)), key=repr)


@pytest.mark.parametrize("entries, levels", [(256, 32), (16, 3), (5, 256)])
def test_codes_match_brute_force(spark, entries, levels):
    rows = awkward(vectors(120))
    found = vector_codes.compress(frame(spark, rows), entries=entries, levels=levels).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_codes(rows, 8, entries=entries)


def test_codes_of_large_numbers_and_of_little(spark):
    rows = [(i, [1e5 * ((i * j) % 7) for j in range(4)], i % 2) for i in range(30)]
    found = vector_codes.compress(frame(spark, rows), entries=4).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_codes(rows, 4, entries=4)
    wide = vector_codes.compress(frame(spark, [(i, [1e30 * (i % 3), 1.0, float(i), -1e35], 1) for i in range(9)]), entries=1).collect()
    assert len(wide) == 9 and any(r["error"] is None for r in wide)
    assert vector_codes.compress(frame(spark, [])).count() == 0
    assert vector_codes.compress(frame(spark, [(1, None, 1)])).count() == 0
    nameless = vector_codes.compress(frame(spark, [(None, [1.0, 2.0, 3.0, 4.0], 1), (None, [5.0, 2.0, 3.0, 4.0], None)]).drop("label")).collect()
    assert sorted(r["code"] for r in nameless) == ["00000000", "01000000"] and {r["error"] for r in nameless} == {0}


def test_a_memo_keeps_every_entry_that_can_win():
    rng = np.random.default_rng(3)
    book, x = rng.integers(-50, 50, (40, 6)), rng.integers(-60, 60, (3000, 6))
    for levels in (1, 2, 7, 256):
        nearest = vector_codes.Nearest(book, vector_codes.Grid.over(x.min(0), x.max(0), levels), levels)
        far = ((x[:, None] - book[None]) ** 2).sum(2)
        for _ in range(2):
            index, best = nearest.find(x)
            assert (index == far.argmin(1)).all() and (best == far.min(1)).all()

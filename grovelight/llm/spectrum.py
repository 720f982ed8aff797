"""Leading eigenpairs of a symmetric matrix by slicing its spectrum."""

from __future__ import annotations

import math

import numpy as np

PIVOT = (1 + math.sqrt(17)) / 8  # the ratio that bounds the growth of entries


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues lie above ``shift``: the positive signs of D in LDL^T = matrix - shift * I.

    Rows and columns are exchanged together, and D has blocks of one or two rows, so indefinite matrices need no luck.
    """
    rest = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(rest):
        column = np.abs(rest[1:, 0])
        most = column.max(initial=0.0)
        own, two = abs(rest[0, 0]), False
        if own < PIVOT * most:
            r = int(column.argmax()) + 1
            row = np.abs(rest[r])
            row[r] = 0.0
            if own * row.max() < PIVOT * most * most:
                two = abs(rest[r, r]) < PIVOT * row.max()
                order = np.arange(len(rest))
                order[[1 if two else 0, r]] = order[[r, 1 if two else 0]]
                rest = rest[np.ix_(order, order)]
        if two:
            block, side = rest[:2, :2], rest[2:, :2]
            det = block[0, 0] * block[1, 1] - block[0, 1] * block[1, 0]
            positive += 1 if det < 0 else 2 * int(block[0, 0] + block[1, 1] > 0)
            inverse = np.array([[block[1, 1], -block[0, 1]], [-block[1, 0], block[0, 0]]]) / det
            rest = rest[2:, 2:] - side @ inverse @ side.T
        elif rest[0, 0] == 0.0:  # the whole column is zero
            rest = rest[1:, 1:]
        else:
            positive += int(rest[0, 0] > 0)
            rest = rest[1:, 1:] - np.outer(rest[1:, 0], rest[1:, 0] / rest[0, 0])
    return positive


def _solved(matrix: np.ndarray, shift: float, v: np.ndarray, found: list[np.ndarray], grain: float) -> np.ndarray:
    """One step of inverse iteration, kept orthogonal to the vectors that are already known."""
    for nudge in (0.0, grain, 3 * grain, 9 * grain):
        try:
            w = np.linalg.solve(matrix - (shift + nudge) * np.eye(len(matrix)), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(w).all() and w.any():
            w /= np.abs(w).max()
            for _ in range(2):
                for u in found:
                    w -= (u @ w) * u
            size = np.linalg.norm(w)
            if size > 0:
                return w / size
    return v


def leading(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as rows): the ``wanted`` largest eigenpairs, largest first.

    For each number j an interval is halved until the counts at its ends say that it holds eigenvalue j alone. Rayleigh quotient
    iteration from its middle then converges cubically. Its result counts only if it lies in the interval, and if the
    counts just above and below it are j - 1 and j; else the interval is halved further. Eigenvalues too close to be told apart in
    double precision share an interval, and their vectors are taken orthogonal to each other.
    """
    matrix = (matrix + matrix.T) / 2
    d = len(matrix)
    norm = float(np.abs(matrix).sum(1).max(initial=0.0))
    grain = np.finfo(float).eps * norm
    close = 4 * math.sqrt(d) * grain
    counts: dict[float, int] = {-2 * norm - 1: d, 2 * norm + 1: 0}

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(matrix, shift)
        return counts[shift]

    values: list[float] = []
    found: list[np.ndarray] = []
    for j in range(1, min(wanted, d) + 1):
        start = np.random.default_rng(j).standard_normal(d)
        for u in found:
            start -= (u @ start) * u
        while True:
            lo = max(s for s, c in counts.items() if c >= j)
            hi = min(s for s, c in counts.items() if c < j and s > lo)
            alone = counts[lo] == j and counts[hi] == j - 1
            middle = (lo + hi) / 2
            narrow = hi - lo <= close or not lo < middle < hi
            if alone or narrow:
                v = start / np.linalg.norm(start)
                for _ in range(2):
                    v = _solved(matrix, middle, v, found, grain)
                rho, best = middle, math.inf
                for _ in range(12):
                    rho = float(v @ matrix @ v)
                    off = float(np.linalg.norm(matrix @ v - rho * v))
                    if off >= best / 2 and best <= close:
                        break
                    best = min(best, off)
                    v = _solved(matrix, middle if narrow and not alone else rho, v, found, grain)
                rho = float(v @ matrix @ v)
                off = float(np.linalg.norm(matrix @ v - rho * v))
                gap = max(close, 2 * off)
                certain = off <= 16 * close and count(rho - gap) >= j and count(rho + gap) <= j - 1
                if narrow or (certain and lo < rho <= hi):
                    break
            count(middle)
        values.append(rho)
        found.append(v)
    return np.array(values), np.array(found).reshape(len(values), d)

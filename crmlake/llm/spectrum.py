"""Leading eigenpairs of a symmetric matrix by spectrum slicing (numpy, in one task).

1. Householder reflections carry the matrix to a tridiagonal T = Q'AQ. Shifted or not, the two
   have the same inertia, and an LDL' factorisation of T - sI takes one step per row.
2. Slicing: the number of negative pivots of T - sI is the number of eigenvalues below s. Counts at many
   shifts are taken at once; halving brackets gives each wanted eigenvalue an interval that holds it
   alone, or, for equal ones, an interval of rounding width that holds them all.
3. Inverse iteration at the middle of an interval, then Rayleigh quotient iteration, which triples the number
   of right digits each step. Equal eigenvalues are taken as a block. A quotient that leaves its interval
   halves the interval and begins again.
4. Counts on both sides of each result certify its number: exactly j - 1 eigenvalues lie above
   the j-th, up to the residual, which bounds its distance from an eigenvalue.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of ``a``."""
    a, d, reflectors = a.copy(), len(a), []
    for k in range(d - 2):
        v = a[k + 1:, k].copy()
        size = np.sqrt(v @ v)
        # a column that is already done (up to what rounding left of it) needs no reflection
        if size > 0 and np.abs(v[1:]).max() > 0:
            v[0] += np.copysign(size, v[0])
            v /= np.sqrt(v @ v)
            p = a[k + 1:, k + 1:] @ v
            w = 2 * (p - (v @ p) * v)
            a[k + 1:, k + 1:] -= np.outer(v, w) + np.outer(w, v)
            a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
        else:
            v = None
        reflectors.append(v)
    return a.diagonal().copy(), a.diagonal(-1).copy(), reflectors


def back(z: np.ndarray, reflectors: list[np.ndarray]) -> np.ndarray:
    """Vectors (columns) of T as vectors of the matrix."""
    z = z.copy()
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        if v is not None:
            z[k + 1:] -= 2 * np.outer(v, v @ z[k + 1:])
    return z


def above(diag: np.ndarray, off: np.ndarray, shifts: np.ndarray, floor: float) -> np.ndarray:
    """Number of eigenvalues at or above each shift: the pivots of LDL' that are not negative."""
    pivot = diag[0] - shifts
    count = np.zeros(len(shifts), int)
    for i in range(len(diag)):
        if i:
            pivot = diag[i] - shifts - off[i - 1] ** 2 / pivot
        pivot = np.where(np.abs(pivot) < floor, -floor, pivot)
        count += pivot > 0
    return count


def solve(diag: np.ndarray, off: np.ndarray, shift: float, rhs: np.ndarray, floor: float) -> np.ndarray:
    """(T - shift I)^-1 rhs by elimination with row exchange."""
    d = len(diag)
    a, b, c = (diag - shift).tolist(), [*off.tolist(), 0.0], [0.0] * d
    low = off.tolist()
    z = rhs.copy()
    for i in range(d - 1):
        if abs(a[i]) < abs(low[i]):
            a[i], low_i = low[i], a[i]
            b[i], a[i + 1] = a[i + 1], b[i]
            c[i], b[i + 1] = b[i + 1], 0.0
            z[[i, i + 1]] = z[[i + 1, i]]
        else:
            low_i = low[i]
        pivot = a[i] = a[i] if abs(a[i]) > floor else floor
        m = low_i / pivot
        a[i + 1] -= m * b[i]
        b[i + 1] -= m * c[i]
        z[i + 1] -= m * z[i]
    a[-1] = a[-1] if abs(a[-1]) > floor else floor
    for i in range(d - 1, -1, -1):
        if i + 1 < d:
            z[i] -= b[i] * z[i + 1]
        if i + 2 < d:
            z[i] -= c[i] * z[i + 2]
        z[i] /= a[i]
    return z


def times(diag: np.ndarray, off: np.ndarray, z: np.ndarray) -> np.ndarray:
    out = diag[:, None] * z
    out[:-1] += off[:, None] * z[1:]
    out[1:] += off[:, None] * z[:-1]
    return out


def leading_eigenpairs(matrix: np.ndarray, k: int, rank_floor: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of the ``k`` largest eigenvalues above
    ``rank_floor`` times the largest absolute one. The sign makes each vector's largest entry positive."""
    d = len(matrix)
    diag, off, reflectors = tridiagonal(np.asarray(matrix, float))
    radius = np.abs(np.r_[off, 0]) + np.abs(np.r_[0, off])
    lo, hi = float((diag - radius).min()), float((diag + radius).max())
    norm = max(abs(lo), abs(hi))
    if norm == 0:
        return np.zeros(0), np.zeros((d, 0))
    floor, width = EPS * norm * EPS, 4 * EPS * norm
    want = np.arange(1, min(k, d) + 1)
    low, high = np.full(len(want), lo - width), np.full(len(want), hi + width)
    n_low, n_high = np.full(len(want), d), np.zeros(len(want), int)

    def halve(rows: np.ndarray) -> None:
        mid = (low[rows] + high[rows]) / 2
        n = above(diag, off, mid, floor)
        right = n >= want[rows]
        low[rows], n_low[rows] = np.where(right, mid, low[rows]), np.where(right, n, n_low[rows])
        high[rows], n_high[rows] = np.where(right, high[rows], mid), np.where(right, n_high[rows], n)
    while len(rows := np.flatnonzero((n_low - n_high > 1) & (high - low > width))):
        halve(rows)
    values, vectors, j = [], [], 0
    rng = np.random.default_rng(7)
    while j < len(want):
        m = int(n_low[j] - n_high[j])
        z = rng.standard_normal((d, m))
        for attempt in range(60):
            mid = (low[j] + high[j]) / 2
            for _ in range(2 if m == 1 else 4):
                z = np.linalg.qr(solve(diag, off, mid, z, floor))[0]
            shift = mid
            for _ in range(12 if m == 1 else 1):
                inner = z.T @ times(diag, off, z)
                if m > 1:                       # a block of equal eigenvalues: Rayleigh-Ritz
                    order = np.linalg.qr(inner)[0]
                    z = z @ order
                shift = float(np.trace(inner)) / m
                rest = times(diag, off, z) - shift * z
                if np.sqrt((rest ** 2).sum(0).max()) <= 8 * EPS * norm * np.sqrt(d):
                    break
                if m == 1:
                    z = np.linalg.qr(solve(diag, off, shift, z, floor))[0]
            slack = max(float(np.sqrt((rest ** 2).sum(0).max())), width)
            ends = above(diag, off, np.array([shift - 2 * slack, shift + 2 * slack]), floor)
            if ends[0] >= n_low[j] and ends[1] <= n_high[j] and low[j] - slack <= shift <= high[j] + slack:
                break
            if high[j] - low[j] > width:
                halve(np.flatnonzero((low == low[j]) & (high == high[j])))
            z = rng.standard_normal((d, m))
        else:
            raise ArithmeticError("an eigenvalue could not be certified")
        values += [shift] * m
        vectors.append(z)
        j = int(n_high[j]) + m
    keep = min(len(want), int(sum(v > rank_floor * norm for v in values)))
    z = np.linalg.qr(np.concatenate(vectors, 1))[0][:, :keep]
    out = np.linalg.qr(back(z, reflectors))[0]
    at = np.abs(out).argmax(0)
    out *= np.where(out[at, np.arange(keep)] < 0, -1.0, 1.0)
    return np.array(values[:keep]), out

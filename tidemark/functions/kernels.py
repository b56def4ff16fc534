"""Numpy kernels that the built-in functions cannot express."""

from __future__ import annotations

import numpy as np


def _dtw(cost: np.ndarray) -> float:
    """Smallest sum of costs over monotone paths from corner to corner, one anti-diagonal at a time."""
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0.0
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        before = np.minimum(np.minimum(total[i - 1, j], total[i, j - 1]), total[i - 1, j - 1])
        total[i, j] = cost[i - 1, j - 1] + before
    return float(total[n, m])


def dtw_abs(x: np.ndarray, y: np.ndarray) -> float:
    """Dynamic time warping of two sequences with absolute differences; infinite if one is empty."""
    if not len(x) or not len(y):
        return float("inf")
    return _dtw(np.abs(np.subtract.outer(np.asarray(x, float), np.asarray(y, float))))


def dtw_multivariate(x: np.ndarray, y: np.ndarray) -> float:
    """Root of the smallest sum of squared Euclidean distances between rows along a warping path."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    cost = ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)
    return float(np.sqrt(_dtw(cost)))


def simplex_weights(z: np.ndarray, vertices: np.ndarray) -> np.ndarray:
    """Weights of at least 0 with sum 1 that bring the mix of vertices (rows) nearest to z."""
    k = len(vertices)
    if k == 1:
        return np.ones(1)
    # a large equation forces the sum; the result is scaled to it exactly
    big = 1e4 * max(1.0, float(np.abs(vertices).max()), float(np.abs(z).max()))
    w = nonnegative_weights(np.append(z, big), np.column_stack([vertices, np.full(k, big)]))
    return w / w.sum()


def nonnegative_weights(z: np.ndarray, vertices: np.ndarray) -> np.ndarray:
    """Weights of at least 0 that bring the weighted sum of vertices (rows) nearest to z, by an active set."""
    a = np.asarray(vertices, float).T
    k = a.shape[1]
    w, free = np.zeros(k), np.zeros(k, bool)
    gradient = a.T @ (z - a @ w)
    tolerance = 1e-12 * max(1.0, float(np.abs(gradient).max()))
    for _ in range(10 * k):
        if free.all() or gradient[~free].max() <= tolerance:
            break
        free[np.where(free, -np.inf, gradient).argmax()] = True
        while True:
            trial = np.zeros(k)
            trial[free] = np.linalg.lstsq(a[:, free], z, rcond=None)[0]
            if trial[free].min() > 0:
                w = trial
                break
            blocked = free & (trial <= 0)
            step = (w[blocked] / (w[blocked] - trial[blocked] + 1e-300)).min()
            w = np.where(free, w + step * (trial - w), 0.0)
            free &= w > 1e-14
            w[~free] = 0.0
            if not free.any():
                break
        gradient = a.T @ (z - a @ w)
    return w


def inversions(ranks: np.ndarray) -> int:
    """Pairs of places whose later one holds the smaller of two non-negative whole numbers; digit by digit from the top, in n log n."""
    r, found = np.asarray(ranks, np.int64), 0
    for bit in range(int(r.max(initial=0)).bit_length() - 1, -1, -1):
        group, one = r >> (bit + 1), (r >> bit) & 1
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        before = np.cumsum(one) - one
        found += int(((before - np.repeat(before[heads], np.diff(np.append(heads, len(r))))) * (1 - one)).sum())
        r = r[np.argsort(r >> bit, kind="stable")]
    return found


def kendall_tau(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-b; NaN where one of the two is constant. Places where one is NaN are left out."""
    known = ~(np.isnan(x) | np.isnan(y))
    a, b = (np.unique(v[known], return_inverse=True)[1] for v in (x, y))
    n = len(a)

    def tied(codes: np.ndarray) -> int:
        counts = np.unique(codes, return_counts=True)[1]
        return int((counts * (counts - 1) // 2).sum())

    pairs = n * (n - 1) // 2
    of_x, of_y = pairs - tied(a), pairs - tied(b)
    if not of_x or not of_y:
        return float("nan")
    score = pairs - tied(a) - tied(b) + tied(a * np.int64(n) + b) - 2 * inversions(b[np.lexsort((b, a))])
    return score / float(np.sqrt(float(of_x) * float(of_y)))

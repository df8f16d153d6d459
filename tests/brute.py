"""Slow, obvious versions of the core computations, for small inputs."""

from itertools import combinations

import numpy as np


def superposed(a, b):
    """Least-squares superposition by singular values: (ssd, 3x4 transform of b)."""
    ma, mb = a.mean(0), b.mean(0)
    u, s, vt = np.linalg.svd((a - ma).T @ (b - mb))
    d = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    rot = u @ np.diag([1, 1, d]) @ vt
    shift = ma - rot @ mb
    moved = b @ rot.T + shift
    return ((moved - a) ** 2).sum(), np.hstack([rot, shift[:, None]])


def cheapest(cost, n):
    """Least cost of n order-preserving pairs, over all choices of rows and columns."""
    m, k = cost.shape
    best = (np.inf, None)
    for rows in combinations(range(m), n):
        for cols in combinations(range(k), n):
            total = sum(cost[i, j] for i, j in zip(rows, cols))
            if total < best[0]:
                best = (total, list(zip(rows, cols)))
    return best


def squared(a, b):
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)


def walk(rng, n, scale=2.0):
    return np.cumsum(rng.normal(size=(n, 3)) * scale, axis=0)

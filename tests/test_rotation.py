"""The superposing transform, with degenerate point sets, against singular values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import chain_table, match_table, pair_table
from strandfold.operators import chains as C
from strandfold.operators import superpose as S

from brute import superposed, walk


def shapes():
    rng = np.random.default_rng(23)
    out = [(walk(rng, n), walk(rng, n)) for n in (3, 3, 4, 7, 30, 200)]
    line = np.arange(6)[:, None] * np.array([[1.0, 2.0, -1.0]])
    turned = line @ np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]]).T + 5
    a = walk(rng, 9)
    out += [
        (line, turned), (line, line), (line, -line), (a, a + 3), (a, a * [-1, 1, 1]), (a, a @ np.diag([-1, -1, 1.0])),
        (line, walk(rng, 6)), (np.zeros((4, 3)), walk(rng, 4)), (np.ones((3, 3)), np.zeros((3, 3))),
        (np.eye(3), np.eye(3)[[1, 0, 2]]), (a * 1e4 + 1e5, walk(rng, 9) * 1e4), (a * 1e-3, walk(rng, 9) * 1e-3),
    ]
    flat = a * [1, 1, 0]
    return out + [(flat, flat @ np.array([[0, 0, 1], [1, 0, 0], [0, 1, 0.0]]).T), (flat, flat * [1, -1, 1])]


@pytest.fixture(scope="module")
def fitted(spark):
    found = shapes()
    coordinates = {2 * k + s: found[k][s] for k in range(len(found)) for s in (0, 1)}
    paired = C.attach_chains(pair_table(spark, [(2 * k, 2 * k + 1) for k in range(len(found))]), chain_table(spark, coordinates))
    matches = match_table(spark, {k: [(n, n) for n in range(len(a))] for k, (a, _) in enumerate(found)})
    return S.superpose(S.matched_points(matches, paired), ["pair_id"], transform=True)


def test_transforms_reach_the_least_ssd_with_proper_rotations(fitted):
    rows = {r.pair_id: r for r in fitted.collect()}
    for k, (a, b) in enumerate(shapes()):
        m = np.array(rows[k].m).reshape(3, 4)
        assert np.isfinite(m).all()
        assert np.allclose(m[:, :3] @ m[:, :3].T, np.eye(3), atol=1e-9) and np.linalg.det(m[:, :3]) > 0.999
        reached = ((b @ m[:, :3].T + m[:, 3] - a) ** 2).sum()
        scale = (a * a).sum() + (b * b).sum() + 1e-30
        assert abs(reached - superposed(a, b)[0]) <= 1e-7 * scale, k




def test_same_matrix_where_there_is_only_one(fitted):
    rows = {r.pair_id: r for r in fitted.filter(F.col("pair_id").isin(2, 3, 4, 5)).collect()}
    for k in (2, 3, 4, 5):
        assert np.allclose(rows[k].m, superposed(*shapes()[k])[1].reshape(-1), atol=1e-6)

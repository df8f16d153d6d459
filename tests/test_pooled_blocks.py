"""Blocks of one shape share kernel calls; solutions are superimposed where they meet their chains."""

import numpy as np
import pytest
from brute import superposed, walk
from helpers import chain_table, pair_table

from strandfold.functions import kernels
from strandfold.operators import align as A
from strandfold.operators import chains as C
from strandfold.operators import orient as O
from strandfold.operators import refine as R
from strandfold.operators import solutions as SOL
from strandfold.operators import superpose as S


def block(rng, pair_id, a, b, count=5, **limits):
    mats = np.stack([np.concatenate([np.linalg.qr(rng.normal(size=(3, 3)))[0], rng.normal(size=(3, 1))], axis=1).reshape(-1) for _ in range(count)])
    row = {"pair_id": pair_id, "o_ids": np.arange(count), "ms": mats.reshape(-1), "n_lo": 2, "n_hi": 99, "n_need": 0, **limits}
    return row | {s + v: x[:, k].copy() for s, x in (("a", a), ("b", b)) for k, v in enumerate("xyz")}


@pytest.fixture(scope="module")
def blocks():
    rng = np.random.default_rng(5)
    return [block(rng, p, walk(rng, 6 + p % 2), walk(rng, 7)) for p in range(9)]


@pytest.mark.parametrize("wanted", [
    A.Search(), A.Search(refine=False), A.Search(keep="all"), A.Search(max_rmsd=2.0), A.Search(refine=False, keep="all", max_dist=6.0),
    A.Search(prefilter=(5.0, 3), n_min=3)])
def test_blocks_of_one_shape_share_calls_and_keep_their_solutions(blocks, wanted, monkeypatch):
    rows = [row | {"n_need": 3 if wanted.prefilter else 0} for row in blocks]
    calls = []
    made = kernels.Layers
    monkeypatch.setattr(kernels, "Layers", lambda *a: calls.append(1) or made(*a))
    jobs = [job for row in rows if (job := A._job(row, wanted)) is not None]
    pools = list(A._pooled(iter(jobs), lambda job: 512))
    assert len(pools) <= 2  # one for each shape
    together = {
        (pool[w].pair_id, o, n): (s, x.tolist(), y.tolist())
        for pool in pools for part in A._pool_solutions(pool, wanted)
        for w, o, n, s, _, _, x, y in zip(*part)}
    assert len(calls) <= 2
    alone = {}
    for row in rows:
        for part in A._block_solutions(row, wanted):
            alone.update({(row["pair_id"], o, n): (s, x.tolist(), y.tolist()) for o, n, s, _, _, x, y in zip(*part)})
    assert together.keys() == alone.keys() and alone
    for key, (ssd, x, y) in alone.items():
        assert together[key][0] == pytest.approx(ssd, abs=1e-9)
        assert [v for v in together[key][1] if v >= 0] == [v for v in x if v >= 0]
        assert [v for v in together[key][2] if v >= 0] == [v for v in y if v >= 0]


@pytest.mark.parametrize("limit", [None, 2.0])
def test_only_the_wanted_count_of_an_orientation_comes_out(blocks, limit):
    wanted = A.Search(keep="all", max_rmsd=limit)
    only = np.array([2, 3, 3, 5, 6])
    every = {(o, n): s for part in A._block_solutions(blocks[0], wanted) for o, n, s, *_ in zip(*part)}
    got = {(o, n): s for part in A._block_solutions(blocks[0] | {"only": only}, wanted) for o, n, s, *_ in zip(*part)}
    assert got == pytest.approx({(o, n): s for (o, n), s in every.items() if n == only[o]})


def test_waiting_blocks_are_bounded(blocks, monkeypatch):
    monkeypatch.setattr(A, "POOLED", 3)
    jobs = [A._job(row, A.Search()) for row in blocks]
    pools = list(A._pooled(iter(jobs), lambda job: 512))
    assert sum(map(len, pools)) == len(jobs) and max(map(len, pools)) <= 3


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(11)
    coordinates = {k: walk(rng, 8) for k in range(5)}
    paired = C.attach_chains(pair_table(spark, [(k, k + 1) for k in range(4)]), chain_table(spark, coordinates)).cache()
    none = O.orientations_from_transforms(spark.createDataFrame([], "pair_id long, o_id long, m array<double>"))
    return coordinates, paired, A.orientation_blocks(O.with_default(none, paired), paired)


def test_listed_points_are_the_matched_points(world):
    coordinates, paired, blocks = world
    found = A.layered_align(blocks, A.Search(n_min=3))
    for r in S.superpose(S.listed_points(found, paired, ["n", "matches"]), ["pair_id", "n", "matches"]).collect():
        i, j = [m.i for m in r.matches], [m.j for m in r.matches]
        assert r.n_atoms == r.n
        assert r.ssd == pytest.approx(superposed(coordinates[r.pair_id][i], coordinates[r.pair_id + 1][j])[0], abs=1e-7)


def test_refinement_exchanges_no_single_matches(spark, world):
    _, paired, blocks = world
    first = SOL.best_per_n(A.layered_align(blocks, A.Search(n_min=3)))
    seeds = first.select("pair_id", "n", "matches.i", "matches.j").selectExpr("pair_id", "cast(n as long) o_id", "i ia", "j jb")
    plan = R._own_blocks(seeds, paired, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "collect_list(struct(k" not in plan
    before = {(r.pair_id, r.n): r.ssd for r in first.collect()}
    after = {(r.pair_id, r.n): r.ssd for r in R.refine(first, paired, A.Search(n_min=3)).collect()}
    assert before.keys() <= after.keys() and all(after[k] <= before[k] + 1e-9 for k in before)

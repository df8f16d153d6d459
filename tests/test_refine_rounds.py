"""A round of refinement gives improvements alone, and pairs without one leave the rounds."""

import os

import numpy as np
import pytest
from brute import walk
from helpers import chain_table, pair_table

from strandfold.operators import align as A
from strandfold.operators import chains as C
from strandfold.operators import orient as O
from strandfold.operators import refine as R
from strandfold.operators import solutions as SOL
from strandfold.session import shared_dir


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(23)
    coordinates = {k: walk(rng, 12) for k in range(9)}
    coordinates[1] = coordinates[0] + 1.0  # pair 0 cannot improve
    paired = C.attach_chains(pair_table(spark, [(k, k + 1) for k in range(8)]), chain_table(spark, coordinates)).cache()
    none = O.orientations_from_transforms(spark.createDataFrame([], "pair_id long, o_id long, m array<double>"))
    blocks = A.orientation_blocks(O.with_default(none, paired), paired)
    return paired, SOL.best_per_n(A.layered_align(blocks, A.Search(n_min=3))).cache()


def test_rounds_hold_improvements_of_open_pairs_only(spark, world, monkeypatch):
    paired, first = world
    best = {(r.pair_id, r.n): r.ssd for r in first.collect()}
    given, found = [], []
    align, per_n = R.layered_align, R.best_per_n
    monkeypatch.setattr(R, "layered_align", lambda blocks, *a, **b: given.append(
        {r.pair_id for r in blocks.select("pair_id").collect()}) or align(blocks, *a, **b))
    monkeypatch.setattr(R, "best_per_n", lambda candidates: found.append(per_n(candidates).cache()) or found[-1])
    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    refined = R.refine(first, paired, A.Search(n_min=3))
    rounds = [[(r.pair_id, r.n, r.ssd) for r in f.collect()] for f in found]
    assert len(rounds) > 2 and not rounds[-1]
    for pairs, rows, later in zip(given, rounds, given[1:]):
        assert {p for p, *_ in rows} == later <= pairs
        for p, n, ssd in rows:
            assert ssd < best.get((p, n), np.inf)
            best[p, n] = ssd
    assert given[0] == set(range(8)) and len(given[-1]) < 8
    origin = {(r.pair_id, r.n): r.o_id for r in first.collect()}
    rows = refined.collect()
    assert {(r.pair_id, r.n): r.ssd for r in rows} == best and refined.columns == first.columns
    assert all(len(r.matches) == r.n and r.o_id == origin.get((r.pair_id, r.n), r.o_id) for r in rows)
    left = {f for f in os.listdir(shared_dir(spark).removeprefix("file://")) if f not in before and f.startswith("refine")}
    assert len(left) == 1  # the result; what the rounds wrote is gone


def test_rounds_stop_where_asked(spark, world):
    paired, first = world
    wanted = A.Search(n_min=3)
    ssd = lambda df: {(r.pair_id, r.n): r.ssd for r in df.collect()}
    assert ssd(R.refine(first, paired, wanted, max_rounds=0)) == ssd(first)
    once = R.refine(first, paired, wanted, max_rounds=1)
    assert ssd(R.refine(once, paired, wanted, max_rounds=1)) == ssd(R.refine(first, paired, wanted, max_rounds=2))


def test_bounds_leave_out_what_does_not_beat_them():
    rng = np.random.default_rng(3)
    a, b = walk(rng, 7), walk(rng, 7)
    mats = np.stack([np.concatenate([np.eye(3), rng.normal(size=(3, 1))], axis=1).reshape(-1) for _ in range(4)])
    row = {"pair_id": 1, "o_ids": np.arange(4), "ms": mats.reshape(-1), "n_lo": 2, "n_hi": 7, "n_need": 0}
    row |= {s + v: x[:, k].copy() for s, x in (("a", a), ("b", b)) for k, v in enumerate("xyz")}
    for search in (A.Search(), A.Search(refine=False)):
        free = {n: s for part in A._block_solutions(row, search) for _, n, s, *_ in zip(*part)}
        bounds = {2: free[2], 3: free[3] * 1.01, 5: free[5] * 0.99, 90: 1.0}
        limits = {"bound_ns": np.array(list(bounds), dtype=np.int32), "bounds": np.array(list(bounds.values()))}
        got = {n: s for part in A._block_solutions(row | limits, search) for _, n, s, *_ in zip(*part)}
        assert got == {n: s for n, s in free.items() if n not in (2, 5)}

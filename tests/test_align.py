"""Alignment operators against exhaustive search on small chains."""

import numpy as np
import pytest
from brute import cheapest, squared, superposed, walk
from helpers import chain_table, pair_table
from pyspark.sql import functions as F

from strandfold.functions import kernels
from strandfold.operators import align as A
from strandfold.operators import chains as C
from strandfold.operators import orient as O
from strandfold.operators import refine as R
from strandfold.operators import solutions as SOL
from strandfold.plans import search


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(7)
    coordinates = {k: walk(rng, n) for k, n in ((0, 6), (1, 7), (2, 5))}
    chains = chain_table(spark, coordinates)
    pairs = pair_table(spark, [(0, 1), (1, 2)])
    paired = C.attach_chains(pairs, chains).cache()
    identity = O.with_default(O.orientations_from_transforms(
        spark.createDataFrame([], "pair_id long, o_id long, m array<double>")), pairs)
    return coordinates, [(0, 1), (1, 2)], paired, A.orientation_blocks(identity, paired)


def test_every_match_count_is_optimal(world):
    coordinates, pairs, _, blocks = world
    got = {(r.pair_id, r.n): r for r in A.layered_align(blocks, A.Search(refine=False)).collect()}
    for pid, (a, b) in enumerate(pairs):
        cost = squared(coordinates[a], coordinates[b])
        for n in range(2, min(cost.shape) + 1):
            total, matches = cheapest(cost, n)
            assert got[pid, n].ssd == pytest.approx(total)
            assert [(m.i, m.j) for m in got[pid, n].matches] == matches
    assert len(got) == 5 + 4


def test_refined_scores_superimpose_own_matches(world):
    coordinates, pairs, _, blocks = world
    for r in A.layered_align(blocks, A.Search(refine=True)).collect():
        a, b = pairs[r.pair_id]
        i, j = [m.i for m in r.matches], [m.j for m in r.matches]
        ssd, _ = superposed(coordinates[a][i], coordinates[b][j])
        assert r.ssd == pytest.approx(ssd, abs=1e-7)
        m = np.array(r.m).reshape(3, 4)
        placed = coordinates[b][j] @ m[:, :3].T + m[:, 3]
        assert ((placed - coordinates[a][i]) ** 2).sum() == pytest.approx(ssd, abs=1e-7)
        assert np.linalg.det(m[:, :3]) == pytest.approx(1.0)


def test_first_violation_ends_the_series(world):
    coordinates, pairs, _, blocks = world
    limit = 2.5
    got = {(r.pair_id, r.n) for r in A.layered_align(blocks, A.Search(max_rmsd=limit, refine=False)).collect()}
    for pid, (a, b) in enumerate(pairs):
        cost = squared(coordinates[a], coordinates[b])
        for n in range(2, min(cost.shape) + 1):
            if np.sqrt(cheapest(cost, n)[0] / n) > limit:
                assert not any(p == pid and k >= n for p, k in got)
                break
            assert (pid, n) in got


def test_reach_and_gap_price(world):
    coordinates, pairs, _, blocks = world
    reach = {r.pair_id: r.reach for r in A.reachable_matches(blocks, 4.0).collect()}
    gaps = {r.pair_id: r for r in A.gap_align(blocks, gap=6.0).collect()}
    for pid, (a, b) in enumerate(pairs):
        cost = squared(coordinates[a], coordinates[b])
        m, k = cost.shape
        best = max([n for n in range(1, min(m, k) + 1) if cheapest(np.where(cost <= 16, 0, 1e9), n)[0] == 0], default=0)
        assert reach[pid] == best
        options = [(m + k) * 6.0] + [cheapest(cost, n)[0] + (m + k - 2 * n) * 6.0 for n in range(1, min(m, k) + 1)]
        if pid in gaps:
            assert gaps[pid].cost == pytest.approx(min(options))
            assert len(gaps[pid].matches) == gaps[pid].n == int(np.argmin(options))
        else:
            assert np.argmin(options) == 0


def test_gap_price_search_meets_its_target(world):
    _, _, _, blocks = world
    for r in A.gap_align(blocks, target_rmsd=2.5).collect():
        assert r.rmsd <= 2.5
    for r in A.gap_align(blocks, target_n=3).collect():
        assert r.n <= 3
    with pytest.raises(ValueError):
        A.gap_align(blocks, gap=1.0, target_n=2)


def test_whole_search_against_enumeration(world):
    """All fragment orientations, all n: the best refined solution of the exhaustive search."""
    coordinates, pairs, paired, _ = world
    got = {(r.pair_id, r.n): r.ssd for r in search.best_solutions(paired, A.Search(), length=4).collect()}
    for pid, (a, b) in enumerate(pairs):
        ca, cb = coordinates[a], coordinates[b]
        best = {}
        for i in range(len(ca) - 3):
            for j in range(len(cb) - 3):
                _, t = superposed(ca[i : i + 4], cb[j : j + 4])
                cost = squared(ca, cb @ t[:, :3].T + t[:, 3])
                for n in range(2, min(cost.shape) + 1):
                    _, ms = cheapest(cost, n)
                    ssd, _ = superposed(ca[[p for p, _ in ms]], cb[[q for _, q in ms]])
                    best[n] = min(best.get(n, np.inf), ssd)
        for n, value in best.items():
            assert got[pid, n] == pytest.approx(value, abs=1e-6)


def test_prefilter_only_drops_orientations(world):
    _, _, paired, _ = world
    every = search.candidates(paired, A.Search(keep="all", refine=False))
    kept = search.candidates(paired, A.Search(keep="all", refine=False, prefilter=(3.0, 4)))
    assert kept.select("pair_id", "o_id", "n").subtract(every.select("pair_id", "o_id", "n")).isEmpty()
    starts = O.fragment_starts(paired, 4)
    blocks = A.orientation_blocks(O.fragment_orientations(starts, 4), paired, O.last_fragment_block())
    good = {(r.pair_id, r.o_id) for r in A.orientation_filter(blocks, 3.0, 4).collect()}
    assert good == {(r.pair_id, r.o_id) for r in kept.select("pair_id", "o_id").distinct().collect()}


def test_refinement_never_worsens_and_ends(world):
    _, _, paired, blocks = world
    wanted = A.Search()
    first = SOL.best_per_n(A.layered_align(blocks, wanted))
    before = {(r.pair_id, r.n): r.ssd for r in first.collect()}
    refined = R.refine(first, paired, wanted)
    after = {(r.pair_id, r.n): r.ssd for r in refined.collect()}
    assert set(before) == set(after)
    assert all(after[k] <= before[k] + 1e-9 for k in before)
    again = {(r.pair_id, r.n): r.ssd for r in R.refine(refined, paired, wanted, max_rounds=1).collect()}
    assert all(again[k] == pytest.approx(after[k]) for k in after)


def test_blocks_and_chunks_do_not_change_the_result(world):
    _, _, paired, _ = world
    oriented = O.fragment_orientations(O.fragment_starts(paired, 4), 4)
    total = lambda block, memory: SOL.best_per_n(A.layered_align(
        A.orientation_blocks(oriented, paired, O.last_fragment_block(block), block), A.Search(memory=memory))).agg(F.sum("ssd")).first()[0]
    assert total(2, 1 << 28) == pytest.approx(total(256, 1))


def test_several_atoms_per_residue(spark):
    rng = np.random.default_rng(3)
    coordinates = {0: walk(rng, 10), 1: walk(rng, 12)}  # 5 and 6 residues of two atoms
    paired = C.attach_chains(pair_table(spark, [(0, 1)]), chain_table(spark, coordinates, atoms=2))
    cost = squared(coordinates[0], coordinates[1])
    residue = cost[0::2, 0::2] + cost[1::2, 1::2]
    identity = O.with_default(O.orientations_from_transforms(
        spark.createDataFrame([], "pair_id long, o_id long, m array<double>")), paired)
    wanted = A.Search(refine=False, atoms_per_residue=2)
    for r in A.layered_align(A.orientation_blocks(identity, paired), wanted).collect():
        total, _ = cheapest(residue, r.n)
        assert r.ssd == pytest.approx(total)
        assert r.rmsd == pytest.approx(np.sqrt(total / (2 * r.n)))


def test_own_cost_function(world):
    coordinates, pairs, _, blocks = world

    def plain_distance(a, b):
        return np.sqrt(kernels.pair_costs(a, b, None))

    for r in A.layered_align(blocks, A.Search(refine=False, cost=plain_distance)).collect():
        a, b = pairs[r.pair_id]
        total, _ = cheapest(np.sqrt(squared(coordinates[a], coordinates[b])), r.n)
        assert r.ssd == pytest.approx(total)


def test_ties_leave_residues_out_first():
    cost = np.zeros((3, 3, 1))
    _, moves = kernels.layered_solve(cost, 2, True)
    a, b = kernels.cell_positions(kernels.trace_layers(moves, np.array([2]), np.array([0])), 3)
    assert (a.tolist(), b.tolist()) == ([[0, 1]], [[0, 1]])


def test_match_counts(spark):
    df = spark.createDataFrame([(10,)], "n int")
    value = lambda spec: df.select(A.match_count(spec, F.col("n")).alias("v")).first().v
    assert [value(s) for s in (3, 0.33, 0.25, 1.0, 1, "1.", "1", "0.5", 2.9)] == [3, 3, 3, 10, 1, 10, 1, 5, 2]
    with pytest.raises(ValueError):
        A.match_count(-1, F.col("n"))

"""Work units, dropped orientations, long chains, mixed sources and late matches of the pair search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import chain_table, match_table, pair_table, transform
from strandfold.functions import geometry as G
from strandfold.functions import kernels
from strandfold.operators import align as A
from strandfold.operators import chains as C
from strandfold.operators import orient as O
from strandfold.operators import solutions as SOL
from strandfold.plans import search

from brute import cheapest, squared, superposed, walk


def all_fragments(a, b, length=4):
    """{o_id: 3x4 transform} of all fragment pairs."""
    return {
        i * len(b) + j: superposed(a[i : i + length], b[j : j + length])[1]
        for i in range(len(a) - length + 1) for j in range(len(b) - length + 1)
    }


def solved_one_by_one(a, b, transforms, low, wanted):
    """(o_id, n) -> ssd with the plain dense recurrence; the first n over a limit ends an orientation."""
    out = {}
    for o_id, m in transforms.items():
        cost = kernels.pair_costs(a[:, None], kernels.moved(b[:, None], m.reshape(1, 12)), wanted.max_dist)
        totals, moves = kernels.layered_solve(cost, min(len(a), len(b)), True)
        for n in range(low, min(len(a), len(b)) + 1):
            ssd = totals[n - 1, 0]
            if not np.isfinite(ssd):
                break
            if wanted.refine:
                cells = kernels.trace_layers(moves, np.array([n]), np.array([0]))[0]
                ssd = superposed(a[cells // len(b)], b[cells % len(b)])[0]
            if wanted.max_rmsd is not None and np.sqrt(ssd / n) > wanted.max_rmsd:
                break
            out[o_id, n] = ssd
    return out


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(17)
    coordinates = {0: walk(rng, 9), 1: walk(rng, 12), 2: walk(rng, 7)}
    pairs = [(0, 1), (1, 2), (2, 0)]
    paired = C.attach_chains(pair_table(spark, pairs), chain_table(spark, coordinates))
    return coordinates, pairs, paired.cache()


@pytest.mark.parametrize("unit,at_once,group", [(512, 256, 3), (5, 3, 1), (1, 1, 2)])
@pytest.mark.parametrize("wanted", [
    A.Search(n_min=3), A.Search(n_min=4, max_rmsd=1.5), A.Search(n_min=3, max_rmsd=2.0, refine=False),
    A.Search(n_min=3, max_dist=2.5), A.Search(n_min=2, refine=False),
])
def test_dropping_between_layers_changes_nothing(world, monkeypatch, unit, at_once, group, wanted):
    monkeypatch.setattr(O, "UNIT", unit)
    monkeypatch.setattr(A, "AT_ONCE", at_once)
    monkeypatch.setattr(A, "GROUP", group)
    coordinates, pairs, paired = world
    got = {(r.pair_id, r.n): r.ssd for r in SOL.best_per_n(search.candidates(paired, wanted)).collect()}
    expected = {}
    for pair, (x, y) in enumerate(pairs):
        a, b = coordinates[x], coordinates[y]
        # the band of n_min leaves out fragments that cannot be part of so many ordered matches
        band = {k: m for k, m in all_fragments(a, b).items()
                if -(len(a) - wanted.n_min) <= k % len(b) - k // len(b) <= len(b) - wanted.n_min}
        for (_, n), ssd in solved_one_by_one(a, b, band, max(wanted.n_min, 2), wanted).items():
            expected[pair, n] = min(ssd, expected.get((pair, n), np.inf))
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-6 for k in got)


@pytest.mark.parametrize("unit", [512, 7, 1])
def test_units_cover_every_start_once(spark, world, monkeypatch, unit):
    monkeypatch.setattr(O, "UNIT", unit)
    coordinates, pairs, paired = world
    boxes = spark.createDataFrame(
        [(0, 0, 8, 2, 9), (0, 1, 5, 0, 7), (0, 1, 5, 0, 7), (0, -3, 2, 0, 30), (1, 4, 7, 1, 5), (1, 0, 2, 0, 6)],
        "pair_id long, a_first int, a_last int, b_first int, b_last int")
    for rectangles in (None, boxes):
        plain = O.fragment_starts(paired, 4, 3) if rectangles is None else O.rectangle_starts(
            paired, rectangles.withColumns({c: F.greatest(c, F.lit(0)) for c in ("a_first", "b_first")}), 4, 3)
        expected = sorted((r.pair_id, r.i0, r.j0) for r in plain.select("pair_id", "i0", "j0").collect())
        found = search.candidates(paired, A.Search(n_min=3, n_max=3, keep="all", refine=False), rectangles=rectangles)
        sizes = {k: len(coordinates[y]) for k, (_, y) in enumerate(pairs)}
        got = sorted((r.pair_id, r.o_id // sizes[r.pair_id], r.o_id % sizes[r.pair_id]) for r in found.collect())
        assert got == expected


def test_a_long_pair_is_dealt_to_many_tasks_before_its_fits(spark):
    rng = np.random.default_rng(2)
    chains = chain_table(spark, {0: walk(rng, 600), 1: walk(rng, 600)})
    paired = C.attach_chains(pair_table(spark, [(0, 1)]), chains)
    units = O.work_units(paired, 4, F.lit(590))
    tasks = units.repartition(24, "pair_id", "unit").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 12
    plan = A.layered_search(O.work_units(paired, 4), A.Search(), 4)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pair_id" in plan and plan.count("MapInArrow") == 1


def test_segments_equal_the_full_traceback():
    rng = np.random.default_rng(4)
    for rows, cols in ((30, 45), (41, 38)):
        cost = rng.integers(0, 6, size=(rows, cols, 1)).astype(float)  # many ties
        cost[rng.random(cost.shape) < 0.05] = np.inf
        most = min(rows, cols)
        totals, moves = kernels.layered_solve(cost, most, True)
        for every in (1, 7, 50):
            layers = kernels.LayersInSegments(cost, 5, most)
            layers.every = every
            got = layers.advance(most)
            finite = np.flatnonzero(np.isfinite(totals[4:, 0])) + 5
            assert (got[4:] == totals[4:]).all()
            columns = np.zeros(len(finite), dtype=np.int64)
            assert (layers.trace(finite, columns) == kernels.trace_layers(moves, finite, columns)).all()


def test_a_long_chain_stays_inside_the_memory_of_the_search():
    import tracemalloc

    rng = np.random.default_rng(6)
    n, memory = 250, 24 << 20  # the full traceback would take about 50 MB
    a, b = walk(rng, n), walk(rng, n)
    row = {"o_ids": np.array([0]), "ms": np.array(G.IDENTITY), "n_lo": 2, "n_hi": n, "n_need": 0, "pair_id": 0}
    row.update({s + v: c[:, k] for s, c in (("a", a), ("b", b)) for k, v in enumerate("xyz")})
    wanted = A.Search(memory=memory)
    assert A._chunk(n, n, n, 1, memory, least=0) == 0
    tracemalloc.start()
    got = {int(v): (s, x[:v].tolist(), y[:v].tolist()) for part in A._block_solutions(row, wanted)
           for v, s, x, y in zip(part[1], part[2], part[5], part[6])}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < memory and sorted(got) == list(range(2, n + 1))
    cost = squared(a, b)[..., None]
    _, moves = kernels.layered_solve(cost, n, True)
    for v in (2, 57, 249):
        cells = kernels.trace_layers(moves, np.array([v]), np.array([0]))[0]
        assert got[v][1:] == ((cells // n).tolist(), (cells % n).tolist())


def test_every_source_of_a_mixed_search(spark, world):
    coordinates, pairs, paired = world
    matches = match_table(spark, {0: [(0, 1), (2, 3), (3, 5), (5, 8)], 1: [(0, 0), (4, 2), (9, 6)]})
    matches = matches.withColumn("o_id", F.lit(3).cast("long"))
    turned = spark.createDataFrame([(0, 0), (99, 0)], "pair_id long, o_id long").withColumn(
        "m", transform([0, -1, 0, 2, 1, 0, 0, 0, 0, 0, 1, -1]))
    wanted = A.Search(n_min=2, refine=False, keep="all")
    given = search.mixed_candidates(paired, wanted, length=None, matches=matches, transforms=turned)
    rows = given.collect()
    assert {(r.pair_id, r.source) for r in rows} == {(0, "matches"), (0, "matrix"), (1, "matches"), (2, "identity")}
    fits = {}
    for pair, ms in ((0, [(0, 1), (2, 3), (3, 5), (5, 8)]), (1, [(0, 0), (4, 2), (9, 6)])):
        x, y = pairs[pair]
        i, j = np.array(ms).T
        fits[pair, "matches"] = superposed(coordinates[x][i], coordinates[y][j])[1]
    fits[0, "matrix"] = np.array([0, -1, 0, 2, 1, 0, 0, 0, 0, 0, 1, -1.0]).reshape(3, 4)
    fits[2, "identity"] = np.array(G.IDENTITY).reshape(3, 4)
    for r in rows:
        if r.n <= 3:
            x, y = pairs[r.pair_id]
            m = fits[r.pair_id, r.source]
            b = coordinates[y] @ m[:, :3].T + m[:, 3]
            assert abs(cheapest(squared(coordinates[x], b), r.n)[0] - r.ssd) < 1e-6
    both = search.mixed_candidates(paired, wanted, matches=matches, transforms=turned)
    counts = {(r.pair_id, r.source): r["count"] for r in both.filter("n = 2").groupBy("pair_id", "source").count().collect()}
    assert counts == {(0, "fragment"): 54, (1, "fragment"): 36, (2, "fragment"): 24, (0, "matches"): 1, (1, "matches"): 1, (0, "matrix"): 1}
    alone = search.mixed_candidates(paired, wanted, length=8).filter("n = 2")
    assert {(r.pair_id, r.source) for r in alone.collect()} == {(0, "fragment"), (1, "identity"), (2, "identity")}


def test_winners_get_the_matches_of_a_full_search(world):
    _, _, paired = world
    wanted = A.Search(n_min=3, keep="all")
    full = search.candidates(paired, wanted)
    light = search.candidates(paired, A.Search(n_min=3, keep="all", matches=False))
    assert "matches" not in light.columns
    ranked = SOL.alternatives(light, 3, lambda m, n, x, y: F.lit(False), rmsd_ratio=3.0)
    solved = A.winners_solved(ranked, paired, wanted, 4).collect()
    every = {(r.pair_id, r.o_id, r.n): (r.ssd, r.matches) for r in full.collect()}
    assert len(solved) == ranked.count() > 20
    for r in solved:
        ssd, matches = every[r.pair_id, r.o_id, r.n]
        assert matches == r.matches and abs(ssd - r.ssd) < 1e-9


def test_alternatives_leave_out_what_is_similar_to_any_better_one(spark):
    rows = [(0, 5, o, float(o * o % 17 + o / 100)) for o in range(60)] + [(1, 5, 3, 1.0)]
    table = spark.createDataFrame(rows, "pair_id long, n int, o_id long, ssd double").withColumn(
        "m", F.array(F.col("o_id").cast("double")))
    near = lambda m, other, x, y: F.abs(m[0] - other[0]) < 4
    got = [(r.pair_id, r["rank"], r.o_id) for r in SOL.alternatives(table, 6, near).collect()]
    left, expected = sorted((s, o) for p, _, o, s in rows if p == 0), []
    while left and len(expected) < 6:
        best = left[0][1]
        expected.append((0, len(expected) + 1, best))
        left = [(s, o) for s, o in left if abs(o - best) >= 4]
    assert sorted(got) == sorted([*expected, (1, 1, 3)])


def test_grid_and_table_find_the_same_close_pairs(spark):
    from strandfold.operators.histogram import pair_distances

    rng = np.random.default_rng(31)
    chains = chain_table(spark, {0: walk(rng, 90), 1: walk(rng, 70), 2: -np.abs(walk(rng, 80))})
    paired = C.attach_chains(pair_table(spark, [(0, 1), (1, 2), (2, 0)]), chains)
    rows = {n: sorted((r.pair_id, r.i, r.j, round(r.d2, 9)) for r in pair_distances(paired, 20, 5.0, grid_from=n).collect())
            for n in (0, 75, 1000)}
    assert rows[0] == rows[75] == rows[1000] and len(rows[0]) > 10

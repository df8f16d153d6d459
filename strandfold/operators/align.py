"""Order-preserving alignments at fixed orientations.

Spark groups orientations into blocks keyed by (pair, block) and attaches the packed chains of the
pair to each block; one pair, however large, is therefore spread over as many tasks as it has blocks.
The batched recurrences run on a block in an Arrow task, and what leaves the task is already reduced
to the best of the block unless all candidates are wanted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandfold.functions import kernels
from strandfold.operators.orient import BLOCK
from strandfold.session import task_count

MEMORY_BUDGET = 256 << 20  # bytes of working tables per kernel call

AT_ONCE = 512  # orientations in one kernel call
POOLED = 4096  # jobs that wait for others of their shape
GROUP = 8  # layers between two looks at a limit on superimposed matches

_LIGHT = "pair_id bigint, o_id bigint, n int, ssd double, rmsd double, m array<double>"
_SOLUTION = f"{_LIGHT}, ia array<int>, jb array<int>"
_NAMES = [c.split()[0] for c in _SOLUTION.split(", ")]


def match_count(spec: int | float | str, n_most: Column) -> Column:
    """A match count given as a number of matches or as a share of ``n_most``.

    Below 1 it is a share, rounded half up; an exact 1 is one match as an int or "1", and all of them
    as a float or "1."; anything larger is a count, fractions dropped.
    """
    value = float(spec)
    if value < 0:
        raise ValueError(f"a match count cannot be negative: {spec}")
    if value == 1.0:
        whole = isinstance(spec, float) or (isinstance(spec, str) and "." in spec)
        return n_most.cast("int") if whole else F.lit(1)
    if value < 1.0:
        return F.floor(F.lit(value) * n_most + 0.5).cast("int")
    return F.lit(int(value))


@dataclass(frozen=True)
class Search:
    """What an alignment search accepts and reports.

    ``n_min``/``n_max`` and the second entry of ``prefilter`` are match counts (see match_count);
    ``prefilter = (distance, count)`` drops orientations that cannot reach ``count`` ordered matches
    within ``distance``.  ``refine`` scores a solution after superimposing its own matches.
    ``matches=False`` leaves the matches out of the result; ``winners_solved`` gives them later.
    ``cost`` replaces the squared distance: a function of (a (m,Q,3), moved b (n,Q,3,K)) -> (m,n,K).
    ``memory`` bounds the working tables of one task; long chains are solved in smaller batches.
    """

    n_min: int | float = 1
    n_max: int | float = 1.0
    max_rmsd: float | None = None
    max_dist: float | None = None
    refine: bool = True
    prefilter: tuple[float, int | float] | None = None
    keep: str = "best"  # "best" of every block and n, or "all"
    cost: Callable | None = None
    atoms_per_residue: int = 1
    memory: int = MEMORY_BUDGET
    matches: bool = True


def orientation_blocks(
    orientations: DataFrame, paired: DataFrame, last_block: Column | None = None, block: int = BLOCK
) -> DataFrame:
    """Blocks of orientations with the packed chains of their pair.

    The chains are copied once per block and joined on (pair_id, block), so no join key is hot.
    ``last_block`` states, in terms of ``paired``, that the blocks of a pair are 0..last_block, which
    saves reading the orientations twice; without it the blocks in use are read off them.
    """
    numbered = orientations.withColumn("block", F.floor(F.col("o_id") / block))
    grouped = numbered.groupBy("pair_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("o_id", "m"))).alias("os")
    )
    if last_block is None:
        homes = numbered.select("pair_id", "block").distinct().join(paired, "pair_id")
    else:
        homes = paired.withColumn(
            "block", F.explode(F.sequence(F.lit(0).cast("long"), last_block.cast("long")))
        )
    return grouped.join(homes, ["pair_id", "block"]).select(
        "pair_id", "block", "na", "nb", F.col("os.o_id").alias("o_ids"),
        F.flatten("os.m").alias("ms"), *[s + v for s in "ab" for v in "xyz"],
    )


def _spread(blocks: DataFrame) -> DataFrame:
    return blocks.repartition(task_count(blocks.sparkSession), "pair_id", "block")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    columns = [batch.column(k) for k in range(batch.num_columns)]
    for r in range(batch.num_rows):
        row = {}
        for name, column in zip(names, columns):
            cell = column[r]
            listed = pa.types.is_list(column.type) and cell.is_valid
            row[name] = cell.values.to_numpy(zero_copy_only=False) if listed else cell.as_py()
        yield row


def _coordinates(row: dict, atoms: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.stack([row[s + v] for v in "xyz"], axis=-1).reshape(-1, atoms, 3) for s in "ab")
    return a, b


def _lists(values: np.ndarray, keep: np.ndarray | None, kind: pa.DataType) -> pa.ListArray:
    """Rows of a matrix as an Arrow list column, optionally without the cells outside ``keep``."""
    if keep is None:
        sizes = np.full(values.shape[0], values.shape[1])
        flat = values.reshape(-1)
    else:
        sizes = keep.sum(axis=1)
        flat = values[keep]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def _chunk(m: int, n: int, depth: int, atoms: int, memory: int = MEMORY_BUDGET, least: int = 1) -> int:
    """Orientations that fit into ``memory`` together."""
    per_orientation = m * n * (32 + depth) + depth * min(m, n) * atoms * 200
    return max(least, memory // per_orientation)


class _Job:
    """The chains of one block or work unit, its orientations and its limits.  Jobs of one ``shape`` can share kernel calls.

    ``only`` has, per orientation, the one match count that is wanted of it; without it all are.  ``bounds`` are match counts
    and the ssd that solutions of them must be under.
    """

    def __init__(self, row: dict, a, b, ids, mats, limits: tuple, only=None, bounds=None):
        self.pair_id, self.a, self.b, self.ids, self.mats, self.only = row.get("pair_id", 0), a, b, ids, mats, only
        self.shape, self.bounds = (len(a), len(b), *limits), bounds

    def costs(self, mats: np.ndarray, max_dist: float | None, cost: Callable | None = None) -> np.ndarray:
        placed = kernels.moved(self.b, mats)
        return kernels.pair_costs(self.a, placed, max_dist) if cost is None else cost(self.a, placed)

    def filtered(self, max_dist: float, need: int, step: int) -> None:
        """Drop the orientations that cannot make ``need`` ordered matches within ``max_dist``."""
        good = [np.zeros(0, dtype=bool)]
        for start in range(0, len(self.ids), step):
            near = np.isfinite(self.costs(self.mats[start : start + step], max_dist))
            good.append(kernels.longest_ordered_matching(near) >= need)
        good = np.concatenate(good)
        self.ids, self.mats = self.ids[good], self.mats[good]


def _pooled(jobs: Iterator[_Job], most: Callable[[_Job], int]) -> Iterator[list[_Job]]:
    """Jobs of one shape together, until they have ``most`` orientations, which depends on their shape.

    Chains that are short take less time than the calls for them, and there are few shapes of short chains.  Long chains
    fill a call by themselves.
    """
    pools: dict[tuple, list[_Job]] = {}
    sizes: Counter = Counter()
    for job in jobs:
        if not len(job.ids):
            continue
        pools.setdefault(job.shape, []).append(job)
        sizes[job.shape] += len(job.ids)
        if sizes[job.shape] >= most(job):
            sizes.pop(job.shape)
            yield pools.pop(job.shape)
        elif sum(map(len, pools.values())) >= POOLED:
            yield from pools.values()
            pools, sizes = {}, Counter()
    yield from pools.values()


def _joined(jobs: list[_Job]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Orientation ids and matrices of all jobs, and whose each is."""
    owner = np.repeat(np.arange(len(jobs)), [len(job.ids) for job in jobs])
    return np.concatenate([job.ids for job in jobs]), np.concatenate([job.mats for job in jobs]), owner


def _joined_costs(jobs: list[_Job], owner: np.ndarray, mats: np.ndarray, max_dist, cost=None) -> np.ndarray:
    cuts = np.flatnonzero(np.diff(owner)) + 1
    parts = [jobs[owner[p]].costs(mats[p:q], max_dist, cost) for p, q in zip([0, *cuts], [*cuts, len(owner)])]
    return parts[0] if len(parts) == 1 else np.concatenate(parts, axis=-1)


def _joined_moments(jobs: list[_Job], owner: np.ndarray, cells: np.ndarray):
    """``kernels.matched_moments`` of solutions of several jobs."""
    if len(jobs) == 1:
        return kernels.matched_moments(jobs[0].a, jobs[0].b, cells)
    used, whose = np.unique(owner, return_inverse=True)
    return kernels.matched_moments_among([jobs[k].a for k in used], [jobs[k].b for k in used], whose, cells)


def _solutions(jobs: list[_Job], search: Search, best: tuple[np.ndarray, np.ndarray] | None):
    """Solve jobs of one shape; yields tuples of equally long arrays (job, o_id, n, ssd, rmsd, m, pos_a, pos_b).

    An orientation is dropped between layers once it cannot contribute: no match set of that size within the distance, a
    limit passed (the first n over it ends an orientation), or, if solutions are scored as placed, no n left at which it
    could still be among the best.  ``best`` has the least ssd, and its o_id, seen so far per job and n; then only better
    ones come out.
    """
    rows, cols, low, high, _ = jobs[0].shape
    atoms = search.atoms_per_residue
    limits = search.max_rmsd is not None
    only = None if jobs[0].only is None else np.concatenate([job.only for job in jobs])
    in_segments = _chunk(rows, cols, high, atoms, search.memory, least=0) == 0
    step = 1 if in_segments else min(AT_ONCE, _chunk(rows, cols, high, atoms, search.memory))
    ids, mats, owners = _joined(jobs)
    for start in range(0, len(ids), step):
        o_ids, t, owner = ids[start : start + step], mats[start : start + step], owners[start : start + step]
        cost = _joined_costs(jobs, owner, t, search.max_dist, search.cost)
        layers = kernels.LayersInSegments(cost, low, high) if in_segments else kernels.Layers(cost, low)
        while layers.depth < high and len(layers.columns):
            first = max(low, layers.depth + 1)
            # limits on superimposed matches need a traceback, which pays for some layers at a time
            count = high if in_segments or not limits else min(high, first + GROUP - 1)
            totals = layers.advance(count - layers.depth)[first - count - 1 :]
            alive = np.logical_and.accumulate(np.isfinite(totals), axis=0)
            going = alive[-1].copy()
            if only is not None:
                wanted = only[start : start + step][layers.columns]
                going &= wanted > count
                if not limits:  # nothing but the counts that are wanted has to be traced
                    alive &= wanted == np.arange(first, count + 1)[:, None]
            depth, column = np.nonzero(alive)
            depth = depth + first
            if len(depth):
                ssd, traced, whose = totals[depth - first, column], None, owner[layers.columns[column]]
                if search.refine:
                    traced = layers.trace(depth, column)
                    cov, mean_a, mean_b, spread = _joined_moments(jobs, whose, traced)
                    ssd = np.maximum(spread - 2 * kernels.best_overlap(cov), 0.0)
                rmsd = np.sqrt(ssd / (depth * atoms))
                pick = np.arange(len(depth))
                if limits:
                    over = np.zeros(totals.shape, dtype=bool)
                    over[depth - first, column] = rmsd > search.max_rmsd
                    over = np.logical_or.accumulate(over, axis=0)
                    going &= ~over[-1]
                    pick = pick[~over[depth - first, column]]
                    if only is not None:
                        pick = pick[depth[pick] == wanted[column[pick]]]
                names = o_ids[layers.columns[column]]
                if best is not None and len(pick):
                    ranked = pick[np.lexsort((names[pick], ssd[pick], depth[pick], whose[pick]))]
                    slot = whose[ranked] * (high + 1) + depth[ranked]
                    ranked = ranked[np.concatenate([[True], np.diff(slot) > 0])]
                    at = whose[ranked], depth[ranked]
                    least, lowest = best[0][at], best[1][at]
                    pick = ranked[(ssd[ranked] < least) | ((ssd[ranked] == least) & (names[ranked] < lowest))]
                    at = whose[pick], depth[pick]
                    best[0][at], best[1][at] = ssd[pick], names[pick]
                if len(pick):
                    if traced is None:
                        cells, fitted = layers.trace(depth[pick], column[pick]), t[layers.columns[column[pick]]]
                    else:
                        cells = traced[pick]
                        fitted = kernels.transforms_of(cov[pick], mean_a[pick], mean_b[pick])
                    pos_a, pos_b = kernels.cell_positions(cells, cols)
                    yield whose[pick], names[pick], depth[pick], ssd[pick], rmsd[pick], fitted, pos_a, pos_b
            if best is not None and not search.refine and count < high:
                # n pairs cost at least n / d times what the best d of them do
                later = np.arange(count + 1, high + 1)
                ceiling = best[0][owner[layers.columns]][:, later].T
                going &= (totals[-1][None] * (later / count)[:, None] <= ceiling).any(axis=0)
            layers.keep(going)


def _job(row: dict, search: Search, orientations=None) -> _Job | None:
    """A block or work unit as a job; None if no match count is possible."""
    a, b = _coordinates(row, search.atoms_per_residue)
    low, high = max(row["n_lo"], 2), min(row["n_hi"], len(a), len(b))
    if low > high:
        return None
    made = (row["o_ids"], row["ms"].reshape(-1, 12)) if orientations is None else orientations(row, a, b)
    bounds = (row["bound_ns"], row["bounds"]) if row.get("bounds") is not None else None
    job = _Job(row, a, b, *made, (low, high, row["n_need"]), row.get("only"), bounds)
    if search.prefilter is not None:
        step = min(AT_ONCE, _chunk(len(a), len(b), high, search.atoms_per_residue, search.memory))
        job.filtered(search.prefilter[0], row["n_need"], step)
    return job


def _pool_solutions(jobs: list[_Job], search: Search):
    """Solutions of jobs of one shape, of all their orientations or per job only the best per n."""
    if search.keep != "best":
        yield from _solutions(jobs, search, None)
        return
    size = len(jobs), jobs[0].shape[3] + 1
    held, last = [], np.full(size, -1)
    least, lowest = np.full(size, np.inf), np.zeros(size, dtype=np.int64)
    for number, job in enumerate(jobs):
        if job.bounds is not None:
            inside = job.bounds[0] < size[1]
            least[number, job.bounds[0][inside]], lowest[number] = job.bounds[1][inside], -1
    for parts in _solutions(jobs, search, (least, lowest)):
        last[parts[0], parts[2]] = len(held)
        held.append(parts)
    for number, parts in enumerate(held):
        rows = last[parts[0], parts[2]] == number
        if rows.any():
            yield tuple(column[rows] for column in parts)


def _block_solutions(row: dict, search: Search, orientations=None):
    """Solutions of one block or work unit: tuples of arrays (o_id, n, ssd, rmsd, m, pos_a, pos_b)."""
    job = _job(row, search, orientations)
    if job is not None and len(job.ids):
        for parts in _pool_solutions([job], search):
            yield parts[1:]


def _solver(search: Search, orientations=None):
    def at_once(job: _Job) -> int:
        return min(AT_ONCE, _chunk(*job.shape[:2], job.shape[3], search.atoms_per_residue, search.memory))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        jobs = (_job(row, search, orientations) for batch in batches for row in _rows(batch))
        for pool in _pooled((job for job in jobs if job is not None), at_once):
            pair_ids = np.array([job.pair_id for job in pool], dtype=np.int64)
            for whose, o_id, n, ssd, rmsd, m, pos_a, pos_b in _pool_solutions(pool, search):
                used = pos_a >= 0
                columns = [
                    pa.array(pair_ids[whose], pa.int64()),
                    pa.array(o_id, pa.int64()), pa.array(n, pa.int32()),
                    pa.array(ssd, pa.float64()), pa.array(rmsd, pa.float64()), _lists(m, None, pa.float64()),
                ]
                if search.matches:
                    columns += [_lists(pos_a, used, pa.int32()), _lists(pos_b, used, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, _NAMES[: len(columns)])

    return run


def zipped_matches() -> Column:
    """The two position lists as one array of (i, j) structs."""
    return F.transform(
        F.arrays_zip("ia", "jb"), lambda p: F.struct(p["ia"].alias("i"), p["jb"].alias("j"))
    ).alias("matches")


def layered_align(blocks: DataFrame, search: Search = Search(), zipped: bool = True) -> DataFrame:
    """For every orientation and n, the cheapest order-preserving set of exactly n pairs.

    Returns candidates (pair_id, o_id, n, ssd, rmsd, m, matches); with keep="best" one per block and
    n.  n = 1 is never reported.  Without ``zipped`` the matches stay two lists, ia and jb.  Blocks may have a list
    ``only``, the one match count wanted of each orientation, and with keep="best" lists ``bound_ns`` and ``bounds``:
    of these match counts, only candidates with an ssd under the bound come out.
    """
    n_most = F.least("na", "nb")
    need = match_count(search.prefilter[1], n_most) if search.prefilter else F.lit(0)
    prepared = _spread(blocks).withColumns({
        "n_lo": match_count(search.n_min, n_most), "n_hi": match_count(search.n_max, n_most), "n_need": need,
    })
    return _solved(prepared, _solver(search), search, zipped)


def _solved(prepared: DataFrame, solver, search: Search, zipped: bool = True) -> DataFrame:
    if not search.matches:
        return prepared.mapInArrow(solver, _LIGHT)
    solved = prepared.mapInArrow(solver, _SOLUTION)
    if not zipped:
        return solved
    return solved.select("pair_id", "o_id", "n", "ssd", "rmsd", "m", zipped_matches())


def fragment_orientation_maker(length: int, max_frag_rmsd: float | None, atoms: int):
    """Orientations of a work unit inside its task: given ones, or the fits of the fragment pairs that start in it."""

    def make(row: dict, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if row["o_ids"] is not None:
            return row["o_ids"], row["ms"].reshape(-1, 12)
        if row["wanted"] is not None:
            i0, j0 = np.divmod(np.unique(row["wanted"]), len(b))
        else:
            rows, cols = np.arange(row["i_from"], row["i_to"]), np.arange(row["j_from"], row["j_to"])
            inside = np.subtract.outer(-rows, -cols)
            inside = (inside >= row["d_lo"]) & (inside <= row["d_hi"])
            if row["boxes"] is not None:
                boxed = np.zeros_like(inside)
                for i, k, j, l in row["boxes"].reshape(-1, 4):
                    boxed[i - rows[0] : k - rows[0] + 1, j - cols[0] : l - cols[0] + 1] = True
                inside &= boxed
            at = np.nonzero(inside)
            i0, j0 = rows[at[0]], cols[at[1]]
        cov, mean_a, mean_b, spread = kernels.fragment_sums(a, b, i0, j0, length)
        if max_frag_rmsd is not None:
            ssd = np.maximum(spread - 2 * kernels.best_overlap(cov), 0.0)
            good = np.sqrt(ssd / (length * atoms)) <= max_frag_rmsd
            i0, j0, cov, mean_a, mean_b = i0[good], j0[good], cov[good], mean_a[good], mean_b[good]
        return i0.astype(np.int64) * len(b) + j0, kernels.transforms_of(cov, mean_a, mean_b)

    return make


def layered_search(
    units: DataFrame, search: Search, length: int, max_frag_rmsd: float | None = None, tasks: int | None = None
) -> DataFrame:
    """``layered_align`` over work units (see ``orient.work_units``): fits, filter and alignment in one task per unit.

    One exchange deals the units out; matrices never leave a task.  ``tasks`` comes from counted work.
    """
    n_most = F.least("na", "nb")
    need = match_count(search.prefilter[1], n_most) if search.prefilter else F.lit(0)
    dealt = units.repartition(tasks or task_count(units.sparkSession), "pair_id", "unit")
    prepared = dealt.withColumns({
        "n_lo": match_count(search.n_min, n_most), "n_hi": match_count(search.n_max, n_most), "n_need": need,
    })
    maker = fragment_orientation_maker(length, max_frag_rmsd, search.atoms_per_residue)
    return _solved(prepared, _solver(search, maker), search)


def winners_solved(winners: DataFrame, paired: DataFrame, search: Search, length: int) -> DataFrame:
    """``winners`` (pair_id, o_id, n, ...) of a search without matches, each fragment orientation solved once more for them.

    Only the orientations that won anything are read, packed in blocks of a pair and joined to its chains; their solutions
    at the match counts they won come back with ``matches``.
    """
    wanted = winners.select("pair_id", "o_id", "n").distinct()
    block = F.pmod(F.xxhash64("o_id"), F.lit(16))
    packed = wanted.groupBy("pair_id", block.alias("unit")).agg(F.collect_set("o_id").alias("wanted"))
    none = {"o_ids": "array<bigint>", "ms": "array<double>", "boxes": "array<int>"}
    units = packed.join(paired, "pair_id").withColumns({k: F.lit(None).cast(t) for k, t in none.items()})
    units = units.select("pair_id", "unit", "na", "nb", *none, "wanted", *[s + v for s in "ab" for v in "xyz"])
    every = replace(search, keep="all", matches=True, prefilter=None, max_rmsd=None)
    solved = layered_search(units, every, length)
    return winners.join(solved.select("pair_id", "o_id", "n", "matches"), ["pair_id", "o_id", "n"])


def reachable_matches(blocks: DataFrame, max_dist: float, atoms_per_residue: int = 1) -> DataFrame:
    """Most ordered matches each orientation can make within ``max_dist``.

    (pair_id, o_id, reach, n_most), n_most being the length of the shorter chain.
    """

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                a, b = _coordinates(row, atoms_per_residue)
                mats = row["ms"].reshape(-1, 12)
                step = _chunk(len(a), len(b), 1, atoms_per_residue)
                for start in range(0, len(mats), step):
                    near = np.isfinite(
                        kernels.pair_costs(a, kernels.moved(b, mats[start : start + step]), max_dist)
                    )
                    reach = kernels.longest_ordered_matching(near)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(reach), row["pair_id"]), pa.int64()),
                            pa.array(row["o_ids"][start : start + step], pa.int64()),
                            pa.array(reach, pa.int32()),
                            pa.array(np.full(len(reach), min(len(a), len(b))), pa.int32()),
                        ],
                        ["pair_id", "o_id", "reach", "n_most"],
                    )

    return _spread(blocks).mapInArrow(run, "pair_id bigint, o_id bigint, reach int, n_most int")


def orientation_filter(blocks: DataFrame, max_dist: float, n_need: int | float) -> DataFrame:
    """Orientations that can make at least ``n_need`` ordered matches within ``max_dist``."""
    reached = reachable_matches(blocks, max_dist)
    return reached.filter(F.col("reach") >= match_count(n_need, F.col("n_most"))).drop("n_most")


# ---- one answer per orientation, at a fixed price per unmatched residue -------------------------


def _ssd_of(cost: np.ndarray, pos_a: np.ndarray, pos_b: np.ndarray) -> np.ndarray:
    used = pos_a >= 0
    cells = cost[np.maximum(pos_a, 0), np.maximum(pos_b, 0), np.arange(len(pos_a))[:, None]]
    return np.where(used, cells, 0.0).sum(axis=1)


def _at_gap(cost: np.ndarray, gap: np.ndarray):
    total, moves = kernels.gap_solve(cost, gap)
    pos_a, pos_b, found = kernels.trace_gaps(moves)
    return total, pos_a, pos_b, found, _ssd_of(cost, pos_a, pos_b)


def _at_breakpoint(cost, atoms, target_rmsd, target_n):
    """The answer with most matches that some price yields and that meets the target, per orientation.

    The answers that prices yield are the corners of the convex hull of (n, cost).  Starting from no match and from all
    of them, the price at which both cost the same is solved: a cheaper answer is a corner between them and replaces
    one, else the two are neighbours and the search ends.  The price reported is the highest that yields the answer.
    """
    k = cost.shape[2]
    width = min(cost.shape[:2])
    allowed = lambda n, ssd: (
        np.sqrt(ssd / np.maximum(n * atoms, 1)) <= target_rmsd if target_n is None else n <= target_n)
    gap = cost.reshape(-1, k).max(axis=0) * width + 1.0  # high enough to match all that can be
    total, pos_a, pos_b, n, ssd = _at_gap(cost, gap)
    over = {"n": n, "ssd": ssd}
    best = {
        "n": np.zeros_like(n), "gap": gap.copy(), "ssd": np.zeros(k), "a": np.full_like(pos_a, -1), "b": np.full_like(pos_b, -1),
    }
    found = {"n": n, "gap": gap, "ssd": ssd, "a": pos_a, "b": pos_b}
    fits = allowed(n, ssd)
    for name, value in found.items():
        best[name][fits] = value[fits]
    active = np.nonzero(~fits)[0]
    while len(active):
        low_n, low_ssd, high_n, high_ssd = best["n"][active], best["ssd"][active], over["n"][active], over["ssd"][active]
        gap = (high_ssd - low_ssd) / (2.0 * (high_n - low_n))
        best["gap"][active] = gap
        _, pos_a, pos_b, n, ssd = _at_gap(cost[:, :, active], gap)
        line = low_ssd - 2.0 * gap * low_n
        corner = (n > low_n) & (n < high_n) & (ssd - 2.0 * gap * n < line - 1e-9 * (1.0 + np.abs(line)))
        fits = corner & allowed(n, ssd)
        for name, value in (("n", n), ("ssd", ssd), ("a", pos_a), ("b", pos_b)):
            best[name][active[fits]] = value[fits]
        beyond = corner & ~fits
        for name, value in (("n", n), ("ssd", ssd)):
            over[name][active[beyond]] = value[beyond]
        active = active[corner]
    best["total"] = best["ssd"] + best["gap"] * (sum(cost.shape[:2]) - 2 * best["n"])
    return best


def gap_align(
    blocks: DataFrame,
    gap: float | None = None,
    target_rmsd: float | None = None,
    target_n: int | float | None = None,
    max_dist: float | None = None,
    refine: bool = False,
    atoms_per_residue: int = 1,
    zipped: bool = True,
) -> DataFrame:
    """One alignment per orientation: (pair_id, o_id, n, gap, cost, ssd, rmsd, m, matches).

    Exactly one of the four criteria is given: a fixed price ``gap`` per unmatched residue, the price
    with most matches among those with rmsd <= target_rmsd or n <= target_n, or as many matches
    within ``max_dist`` as possible.  Without ``zipped`` the matches stay two lists, ia and jb.
    """
    if sum(v is not None for v in (gap, target_rmsd, target_n, max_dist)) != 1:
        raise ValueError("give exactly one of gap, target_rmsd, target_n, max_dist")
    if gap is not None and gap <= 0:
        raise ValueError("the price of an unmatched residue must be positive")

    def at_once(job: _Job) -> int:
        return _chunk(*job.shape[:2], 24, atoms_per_residue)

    def job_of(row: dict) -> _Job:
        a, b = _coordinates(row, atoms_per_residue)
        return _Job(row, a, b, row["o_ids"], row["ms"].reshape(-1, 12), (row["n_target"],))

    def run(batches):
        jobs = (job_of(row) for batch in batches for row in _rows(batch))
        for pool in _pooled(jobs, lambda job: min(AT_ONCE, at_once(job))):
            rows, cols, wanted = pool[0].shape
            pair_ids = np.array([job.pair_id for job in pool], dtype=np.int64)
            all_ids, mats, owners = _joined(pool)
            step = at_once(pool[0])
            for start in range(0, len(mats), step):
                t, ids, owner = mats[start : start + step], all_ids[start : start + step], owners[start : start + step]
                cost = _joined_costs(pool, owner, t, max_dist)
                if target_rmsd is not None or target_n is not None:
                    got = _at_breakpoint(cost, atoms_per_residue, target_rmsd, None if target_n is None else wanted)
                    n, price, total, ssd, pos_a, pos_b = (got[v] for v in ("n", "gap", "total", "ssd", "a", "b"))
                else:
                    fixed = gap if gap is not None else 0.5 * max_dist**2 * min(rows, cols) * atoms_per_residue
                    price = np.full(len(ids), fixed)
                    total, pos_a, pos_b, n, ssd = _at_gap(cost, price)
                keep = np.nonzero(n > 0)[0]
                if not len(keep):
                    continue
                pos_a, pos_b, n, ssd, m, whose = pos_a[keep], pos_b[keep], n[keep], ssd[keep], t[keep], owner[keep]
                if refine:
                    cells = np.where(pos_a < 0, -1, pos_a.astype(np.int64) * cols + pos_b)
                    cov, mean_a, mean_b, spread = _joined_moments(pool, whose, cells)
                    ssd = np.maximum(spread - 2 * kernels.best_overlap(cov), 0.0)
                    m = kernels.transforms_of(cov, mean_a, mean_b)
                used = pos_a >= 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pair_ids[whose], pa.int64()),
                        pa.array(ids[keep], pa.int64()), pa.array(n, pa.int32()),
                        pa.array(price[keep]), pa.array(total[keep]), pa.array(ssd),
                        pa.array(np.sqrt(ssd / (n * atoms_per_residue))),
                        _lists(m, None, pa.float64()),
                        _lists(pos_a, used, pa.int32()), _lists(pos_b, used, pa.int32()),
                    ],
                    ["pair_id", "o_id", "n", "gap", "cost", "ssd", "rmsd", "m", "ia", "jb"],
                )

    target = match_count(target_n, F.least("na", "nb")) if target_n is not None else F.lit(0)
    solved = _spread(blocks).withColumn("n_target", target).mapInArrow(
        run,
        "pair_id bigint, o_id bigint, n int, gap double, cost double, ssd double, rmsd double, "
        "m array<double>, ia array<int>, jb array<int>",
    )
    if not zipped:
        return solved
    return solved.select(
        "pair_id", "o_id", "n", "gap", "cost", "ssd", "rmsd", "m", zipped_matches()
    )


def best_single_answer(answers: DataFrame) -> DataFrame:
    """Per pair the answer with most matches, then least rmsd, then lowest orientation id."""
    rank = F.struct(-F.col("n"), F.col("rmsd"), F.col("o_id"))
    row = F.struct(*[c for c in answers.columns if c != "pair_id"])
    return answers.groupBy("pair_id").agg(F.min_by(row, rank).alias("r")).select("pair_id", "r.*")

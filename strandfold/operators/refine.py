"""Iterative refinement: superimpose a solution on its own matches, align again, keep improvements."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandfold.functions import geometry as G
from strandfold.operators.align import Search, best_single_answer, gap_align, layered_align, zipped_matches
from strandfold.operators.orient import BLOCK
from strandfold.operators.solutions import best_per_n
from strandfold.operators.superpose import listed_points, match_moments
from strandfold.session import cut_lineage, materialise, release

# An update must beat the stored ssd by more than rounding, or rounds could alternate for ever.
LEAST_GAIN = 1e-9

SOLVED = ("ssd", "rmsd", "m", "ia", "jb")


def _listed(solutions: DataFrame) -> DataFrame:
    """Solutions with their matches as two lists, which take a quarter of the bytes."""
    return solutions.withColumns({"ia": F.col("matches.i"), "jb": F.col("matches.j")}).drop("matches")


def _packed(solutions: DataFrame) -> DataFrame:
    """Listed solutions, all marked as changed."""
    return cut_lineage(_listed(solutions).withColumn("changed", F.lit(True)))


def _unpacked(solutions: DataFrame, columns: list[str]) -> DataFrame:
    return solutions.select(*[zipped_matches() if c == "matches" else F.col(c) for c in columns])


def _own_blocks(
    seeds: DataFrame, paired: DataFrame, atoms: int, block: int = BLOCK, extra: tuple[str, ...] = (),
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Blocks of the transforms that superimpose seeds (pair_id, o_id, ia, jb) on their own matches.

    Seeds meet the chains of their pair by pair_id, and so do the blocks made of them: of those a pair has few.  The lists of
    ``bounds`` (pair_id, bound_ns, bounds) go with the blocks of their pair.
    """
    keys = ["o_id", *extra]
    sets = seeds.select("pair_id", *keys, F.col("ia").alias("i"), F.col("jb").alias("j"))
    points = listed_points(sets.withColumn("matches", F.arrays_zip("i", "j")), paired, keys, atoms)
    fits = match_moments(points, ["pair_id", *keys]).select("pair_id", *keys, G.fitted_transform().alias("m"))
    grouped = fits.withColumn("block", F.floor(F.col("o_id") / block)).groupBy("pair_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("o_id", "m", *extra))).alias("os")
    )
    lists = []
    if bounds is not None:  # beside the chains, which both joins read alike
        grouped, lists = grouped.join(bounds, "pair_id"), ["bound_ns", "bounds"]
    # lengths from the chains themselves, so that both joins read the same columns and share one exchange of the chains
    lengths = [(F.size(f"{s}x") / atoms).cast("int").alias(f"n{s}") for s in "ab"]
    return grouped.join(paired, "pair_id").select(
        "pair_id", "block", *lengths, F.col("os.o_id").alias("o_ids"), F.flatten("os.m").alias("ms"),
        *[F.col(f"os.{c}").alias(c) for c in extra], *lists, *[s + v for s in "ab" for v in "xyz"],
    )


def _bounds(solutions: DataFrame) -> DataFrame:
    """(pair_id, bound_ns, bounds): per pair the match counts with a solution and the ssd that an update must be under."""
    known = F.when(F.col("ssd").isNotNull() & ~F.isnan("ssd"), F.struct("n", (F.col("ssd") * (1 - LEAST_GAIN)).alias("least")))
    grouped = solutions.groupBy("pair_id").agg(F.collect_list(known).alias("k"))
    return grouped.select("pair_id", F.col("k.n").alias("bound_ns"), F.col("k.least").alias("bounds"))


def _lowered(bounds: DataFrame, new: DataFrame) -> DataFrame:
    """The bounds of the pairs of ``new``, which has lower ones or ones of further match counts."""
    new = new.withColumnsRenamed({"bound_ns": "_ns", "bounds": "_least"})
    stays = lambda k: ~F.array_contains("_ns", k["bound_ns"])
    kept = F.filter(F.arrays_zip("bound_ns", "bounds"), stays)
    return bounds.join(new, "pair_id").withColumn("k", kept).select(
        "pair_id", F.concat("k.bound_ns", "_ns").alias("bound_ns"), F.concat("k.bounds", "_least").alias("bounds"))


def refine(
    solutions: DataFrame, paired: DataFrame, search: Search, max_rounds: int | None = None
) -> DataFrame:
    """Refine rank-1 solutions to a fixed point.

    A round takes the solutions that changed in the round before, all pairs and match counts at once,
    uses their superpositions as orientations and updates every n that improves.  It ends when no
    solution improves; each round starts from reliable storage, so lost executors cost one round.

    A round gets the bounds that a solution must be under and gives improvements alone.  Pairs without one are done; the
    chains and bounds of the others are written for the next round.  What the rounds gave meets the solutions once, at the end.
    """
    if max_rounds is not None and max_rounds < 1:
        return solutions
    first = materialise(_listed(solutions), "refine-first")
    best = replace(search, keep="best", prefilter=None)
    chains, bounds = paired, materialise(_bounds(first), "refine-bounds")
    seeds, improved = first, []
    while max_rounds is None or len(improved) < max_rounds:
        named = seeds.select("pair_id", F.col("n").cast("long").alias("o_id"), "ia", "jb")
        blocks = _own_blocks(named, chains, search.atoms_per_residue, bounds=bounds)
        seeds = materialise(best_per_n(layered_align(blocks, best, zipped=False)), "refine-round")
        improved.append(seeds)
        if seeds.isEmpty():
            break
        former = [t for t in (chains, bounds) if t is not paired]
        bounds = materialise(_lowered(bounds, _bounds(seeds)), "refine-bounds")
        chains = materialise(chains.join(seeds.select("pair_id").distinct(), "pair_id", "left_semi"), "refine-chains")
        release(*former)
    rounds = [t.withColumn("round", F.lit(k)) for k, t in enumerate(improved)]
    last = reduce(DataFrame.unionByName, rounds).groupBy("pair_id", "n").agg(
        F.max_by(F.struct(*SOLVED), "round").alias("s"), F.min_by("o_id", "round").alias("_o_id"))
    joined = first.join(last, ["pair_id", "n"], "full_outer")
    # the orientation id of an improved solution stays that of the search it descends from
    updated = joined.select("pair_id", "n", F.coalesce("o_id", "_o_id").alias("o_id"), *[
        F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(c)).alias(c) for c in SOLVED])
    current = materialise(updated, "refined")
    release(first, bounds, *improved, *([] if chains is paired else [chains]))
    return _unpacked(current, solutions.columns)


def refine_ranks(
    solutions: DataFrame, paired: DataFrame, search: Search, max_rounds: int | None = None
) -> DataFrame:
    """Refine every ranked solution on its own; rank 1 also shares improvements between match counts.

    Ranks above 1 are local optima: only the alignment with the solution's own n may replace it.
    """
    top = refine(
        solutions.filter("rank = 1").drop("rank"), paired, search, max_rounds
    ).withColumn("rank", F.lit(1))
    others = _packed(solutions.filter("rank > 1"))
    every = replace(search, keep="all", prefilter=None)
    rounds = 0
    while not others.filter("changed").isEmpty() and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        width = 1 << 20  # rank and n packed into one orientation id
        seeds = others.filter("changed").select(
            "pair_id", (F.col("n").cast("long") + F.col("rank").cast("long") * width).alias("o_id"), "ia", "jb",
            F.col("n").alias("only"),
        )
        # one block per rank; of an orientation only its own n is traced
        blocks = _own_blocks(seeds, paired, search.atoms_per_residue, width, ("only",))
        own = layered_align(blocks, every, zipped=False).select(
            "pair_id", "n", F.floor(F.col("o_id") / width).cast("int").alias("rank"),
            *[F.col(c).alias(f"_{c}") for c in SOLVED],
        )
        joined = others.join(own, ["pair_id", "rank", "n"], "left")
        better = F.col("_ssd").isNotNull() & (F.col("_ssd") < F.col("ssd") * (1 - LEAST_GAIN))
        others = cut_lineage(joined.select(
            "pair_id", "n", "rank", "o_id",
            *[F.when(better, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in SOLVED],
            F.coalesce(better, F.lit(False)).alias("changed"),
        ))
    return top.select(*solutions.columns).unionByName(_unpacked(others, solutions.columns))


def refine_single(
    answers: DataFrame, paired: DataFrame, max_rounds: int | None = None, atoms_per_residue: int = 1, **criterion
) -> DataFrame:
    """Refine one answer per pair: superimpose, align again at the same criterion, keep if better."""
    columns = answers.columns
    current = _packed(answers)
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        seeds = current.filter("changed").select("pair_id", F.lit(0).cast("long").alias("o_id"), "ia", "jb")
        found = best_single_answer(gap_align(
            _own_blocks(seeds, paired, atoms_per_residue), refine=True, atoms_per_residue=atoms_per_residue,
            zipped=False, **criterion
        ))
        fields = [c for c in current.columns if c not in ("pair_id", "o_id", "changed")]
        new = found.select("pair_id", *[F.col(c).alias(f"_{c}") for c in fields])
        joined = current.join(new, "pair_id", "left")
        better = F.coalesce(
            (F.col("_n") > F.col("n"))
            | ((F.col("_n") == F.col("n")) & (F.col("_rmsd") < F.col("rmsd") * (1 - LEAST_GAIN))),
            F.lit(False),
        )
        current = cut_lineage(joined.select(
            "pair_id", "o_id", *[F.when(better, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fields],
            better.alias("changed"),
        ))
        if current.filter("changed").isEmpty():
            break
    return _unpacked(current, columns)

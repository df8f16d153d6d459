"""The pair search end to end: orientations, filter, alignment, best or alternatives, refinement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandfold.functions import geometry as G
from strandfold.operators import align as A
from strandfold.operators import orient as O
from strandfold.operators import refine as R
from strandfold.operators import solutions as SOL
from strandfold.operators import superpose as S
from strandfold.session import task_count

# Cell updates of the recurrence that one task should have, some ten seconds.
WORK_PER_TASK = 2_000_000_000
# Sources of orientations share one id space: the source in the upper bits, its own number below.
SOURCE_BITS = 48
SOURCES = ("fragment", "matches", "matrix", "identity")


def task_need(paired: DataFrame) -> int:
    """Tasks for a search over all fragment pairs, from the counted lengths of the chains; never below the usual number.

    The count is a job of its own.  On a local master, whose cores all tasks share anyway, it is left out.
    """
    spark = paired.sparkSession
    if spark.conf.get("spark.strandfold.tasks", None) or spark.sparkContext.master.startswith("local"):
        return task_count(spark)
    cells = F.col("na").cast("double") * F.col("nb")
    work = paired.agg(F.sum(cells * cells * F.least("na", "nb") / 3)).first()[0] or 0.0
    return max(task_count(spark), int(work // WORK_PER_TASK) + 1)


def candidates(
    paired: DataFrame,
    search: A.Search,
    length: int = 4,
    max_frag_rmsd: float | None = None,
    rectangles: DataFrame | None = None,
) -> DataFrame:
    """Candidates from all fragment orientations of every pair, or from those inside rectangles.

    Work is dealt out in units of fragment starts, known from the chain lengths; a unit's fits and alignments happen in the
    task that gets it.
    """
    n_min = A.match_count(search.n_min, F.least("na", "nb"))
    units = O.work_units(paired, length, n_min, rectangles)
    return A.layered_search(units, search, length, max_frag_rmsd, task_need(paired))


def _numbered(orientations: DataFrame, source: str) -> DataFrame:
    base = F.lit(SOURCES.index(source)).cast("long") * (1 << SOURCE_BITS)
    return orientations.select("pair_id", (F.col("o_id").cast("long") + base).alias("o_id"), "m")


def source_of(o_id: Column) -> Column:
    """Name of the source that gave an orientation of a mixed search."""
    return F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.shiftright(o_id, SOURCE_BITS) + 1).cast("int"))


def mixed_candidates(
    paired: DataFrame,
    search: A.Search,
    length: int | None = 4,
    max_frag_rmsd: float | None = None,
    rectangles: DataFrame | None = None,
    matches: DataFrame | None = None,
    transforms: DataFrame | None = None,
) -> DataFrame:
    """Candidates from every source a pair has: fragment pairs, known alignments, given transforms.

    ``length = None`` leaves fragments out; ``matches`` is (pair_id, o_id, k, i, j), one superposition per (pair_id, o_id);
    ``transforms`` is (pair_id, o_id, m), o_id counting within the source.  A pair for which no source has an orientation is
    aligned as placed.  All units go through one alignment stage; ``source`` names where a candidate comes from.
    """
    n_min = A.match_count(search.n_min, F.least("na", "nb"))
    given = []
    if matches is not None:
        points = S.matched_points(matches, paired, search.atoms_per_residue)
        fits = S.superpose(points, ["pair_id", "o_id"], transform=True)
        given.append(_numbered(fits, "matches"))
    if transforms is not None:
        known = transforms.join(paired.select("pair_id"), "pair_id", "left_semi")
        given.append(_numbered(known, "matrix"))
    units = O.work_units(paired, length, n_min, rectangles) if length is not None else None
    served = [g.select("pair_id") for g in given] + ([units.select("pair_id")] if units is not None else [])
    lone = paired.select("pair_id")
    if served:
        lone = lone.join(reduce(DataFrame.unionAll, served), "pair_id", "left_anti")
    given.append(_numbered(lone.select("pair_id", F.lit(0).alias("o_id"), G.identity().alias("m")), "identity"))
    # units of given orientations get negative numbers, apart from those of fragments
    packed = O.given_units(reduce(DataFrame.unionAll, given), paired).withColumn("unit", -1 - F.col("unit"))
    units = packed if units is None else units.unionByName(packed)
    found = A.layered_search(units, search, length or 3, max_frag_rmsd, task_need(paired))
    return found.withColumn("source", source_of(F.col("o_id")))


def best_solutions(paired: DataFrame, search: A.Search, **orientation_options) -> DataFrame:
    """Best solution per pair and match count."""
    return SOL.best_per_n(candidates(paired, search, **orientation_options))


def refined_solutions(
    paired: DataFrame, search: A.Search, max_rounds: int | None = None, **orientation_options
) -> DataFrame:
    """Best solutions refined to a fixed point."""
    return R.refine(best_solutions(paired, search, **orientation_options), paired, search, max_rounds)

"""Keeping the best, and the best mutually different, solutions per pair and match count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandfold.functions import geometry as G
from strandfold.functions.skew import hot_keys, spread_join
from strandfold.session import cut_lineage

SLOT = ["pair_id", "n"]


def best_per_n(candidates: DataFrame) -> DataFrame:
    """The candidate with least ssd per pair and match count; the lower orientation id wins ties."""
    row = F.struct(*[c for c in candidates.columns if c not in SLOT])
    return (
        candidates.groupBy(*SLOT).agg(F.min_by(row, F.struct("ssd", "o_id")).alias("r"))
        .select(*SLOT, "r.*")
    )


def prefix_valid(candidates: DataFrame, violated: Column) -> DataFrame:
    """Drop, per orientation, the first n that violates a limit and everything after it."""
    up_to = W.partitionBy("pair_id", "o_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    flagged = candidates.withColumn("_bad", F.max(violated.cast("int")).over(up_to))
    return flagged.filter(F.col("_bad") == 0).drop("_bad")


def within_ratio(candidates: DataFrame, ratio: float) -> DataFrame:
    """Candidates whose rmsd is at most ``ratio`` times the best of their pair and match count.

    Candidates are read more than once, so costly ones should be materialised first.
    """
    best = candidates.groupBy(*SLOT).agg(F.min("ssd").alias("_least"))
    joined = _with_slot_row(candidates, best)
    return joined.filter(F.col("ssd") <= F.col("_least") * ratio * ratio).drop("_least")


def _with_slot_row(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """Join the single row a slot owns to all candidates of the slot, splitting hot slots."""
    slot = F.struct(*SLOT)
    keyed = rows.withColumn("_slot", slot).drop(*SLOT)
    return spread_join(candidates.withColumn("_slot", slot), keyed, "_slot", ["o_id"]).drop("_slot")


def similar_orientation(min_rms: float) -> Callable[[Column, Column, Column, Column], Column]:
    """Similar = the points of b are displaced by less than ``min_rms`` (root mean square)."""

    def similar(m, other_m, matches, other_matches):
        w = F.col("w")
        return G.displacement_ssd(m, other_m, w) < min_rms * min_rms * w["w33"]

    return similar


def similar_pairs(max_common: int) -> Callable[[Column, Column, Column, Column], Column]:
    """Similar = more than ``max_common`` matched pairs in common."""
    return lambda m, other_m, matches, other_matches: (
        F.size(F.array_intersect(matches, other_matches)) > max_common
    )


def alternatives(
    candidates: DataFrame,
    count: int,
    similar: Callable[[Column, Column, Column, Column], Column],
    rmsd_ratio: float | None = None,
    moments: DataFrame | None = None,
) -> DataFrame:
    """Up to ``count`` mutually different candidates per pair and match count, best first.

    One round per rank: the best remaining candidate of every slot is taken by a partial + final aggregation, then everything
    similar to it (itself included) is dropped.  Which similar test is used is up to the caller; ``similar_orientation``
    needs ``moments`` (pair_id, w) of chain b, and no matches: give it light candidates and let ``align.winners_solved``
    find the matches of the winners.  What remains is written per round, so candidates should hold no more than that.
    """
    kept_columns = [c for c in candidates.columns if c not in SLOT]
    remaining = cut_lineage(candidates)
    if rmsd_ratio is not None:
        remaining = within_ratio(remaining, rmsd_ratio)
    hot = hot_keys(remaining.select(F.struct(*SLOT).alias("key")))
    if moments is not None:
        # the few numbers of a pair ride along; they are not written before the first winners are out
        remaining = spread_join(remaining, moments.select("pair_id", "w"), "pair_id", ["o_id", "n"])
    elif rmsd_ratio is not None:
        remaining = cut_lineage(remaining)
    chosen = None
    for rank in range(1, count + 1):
        winners = best_per_n(remaining.select(*SLOT, *kept_columns))
        ranked = winners.withColumn("rank", F.lit(rank))
        chosen = ranked if chosen is None else chosen.unionByName(ranked)
        if rank == count:
            break
        rival = winners.select(
            F.struct(*SLOT).alias("_slot"), F.col("o_id").alias("_o_id"),
            *[F.col(c).alias(f"_{c}") for c in ("m", "matches") if c in winners.columns],
        )
        joined = spread_join(remaining.withColumn("_slot", F.struct(*SLOT)), rival, "_slot", ["o_id"], hot)
        column = lambda c: F.col(c) if c in joined.columns else F.lit(None)
        alike = similar(column("m"), column("_m"), column("matches"), column("_matches"))
        remaining = cut_lineage(
            joined.filter((F.col("o_id") != F.col("_o_id")) & ~alike).select(*remaining.columns)
        )
    return chosen.select(*SLOT, "rank", *kept_columns)


def orientations_in_use(candidates: DataFrame, rmsd_ratio: float) -> DataFrame:
    """Orientations that gave some alignment within ``rmsd_ratio`` of the best: (pair_id, o_id)."""
    return within_ratio(candidates, rmsd_ratio).select("pair_id", "o_id").distinct()


def winning_orientations(solutions: DataFrame) -> DataFrame:
    """Which (n, rank) slots each orientation serves: one row per orientation, so it is solved once."""
    return solutions.groupBy("pair_id", "o_id").agg(
        F.count(F.lit(1)).alias("slots"), F.min("n").alias("n_first"), F.max("n").alias("n_last")
    )


def prune_alternatives(
    solutions: DataFrame,
    similar: Callable[[Column, Column, Column, Column], Column],
    rmsd_ratio: float | None = None,
    moments: DataFrame | None = None,
) -> DataFrame:
    """Sort ranked solutions again, delete those similar to a better one or over the ratio, renumber.

    The greedy rule is the one of ``alternatives``, so it runs as the same rounds over the ranked set;
    as many rounds as there are ranks keep every survivor.
    """
    ranks = solutions.agg(F.max("rank")).first()[0]
    # the old rank stands in for the orientation id: unique in its slot and the tie-break
    keyed = solutions.withColumn("_from", F.col("o_id")).withColumn("o_id", F.col("rank").cast("long")).drop("rank")
    pruned = alternatives(keyed, ranks or 1, similar, rmsd_ratio, moments)
    return pruned.withColumn("o_id", F.col("_from")).drop("_from")


def best_match(series: DataFrame, metric: str, keys: list[str], largest: bool = True) -> DataFrame:
    """The n of a series of compared alignments with the best value of a metric (lowest n on ties)."""
    value = F.col(metric) if largest else -F.col(metric)
    rank = F.struct(value.alias("v"), (-F.col("n")).alias("minus_n"))
    row = F.struct(*[c for c in series.columns if c not in keys])
    return (
        series.filter(F.col(metric).isNotNull()).groupBy(*keys)
        .agg(F.max_by(row, rank).alias("r")).select(*keys, "r.*")
    )


def best_by_probability(series: DataFrame, keys: list[str], n_from: int = 20) -> DataFrame:
    """The n with the least chance probability, from ``n_from`` matches up."""
    return best_match(series.filter(F.col("n") >= n_from), "p_str", keys, largest=False)


def depth_histogram(candidates: DataFrame) -> DataFrame:
    """How many orientations reached each match count as their last, and how many at least it."""
    last = candidates.groupBy("pair_id", "o_id").agg(F.max("n").alias("last_n"))
    counted = last.groupBy("last_n").agg(F.count(F.lit(1)).alias("orientations"))
    # at most one row per match count, i.e. as many as the longest chain has residues
    up = W.orderBy(F.col("last_n").desc()).rowsBetween(W.unboundedPreceding, 0)
    return counted.withColumn("at_least", F.sum("orientations").over(up))

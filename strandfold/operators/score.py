"""Similarity score, its chance probability, and statistics rows of alignments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandfold.functions.geometry import fitted_transform, identity, moment_sums, squared_distance, transformed
from strandfold.operators.superpose import distances, side

# Fixed values of the similarity score: weight, squared distance scale, price of a gap.
SCORE_WEIGHT = 20.0
SCORE_SCALE = 25.0
GAP_PRICE = 10.0

# Fixed values of the extreme-value fit of the score: mean c, d, e; spread f, g; break at 120 matches;
# logarithm of 5000, above which the probability is its leading term.
FIT_C, FIT_D, FIT_E = 18.411424, -4.501719, 2.637163
FIT_F, FIT_G = 21.351857, -37.521269
FIT_BREAK = 120
LEADING_TERM_FROM = math.log(5000.0)

_LN = math.log(FIT_BREAK)
_SLOPE = 2 * _LN * FIT_C + FIT_D
_OFFSET = _LN * _LN * FIT_C + _LN * FIT_D + FIT_E - _SLOPE * _LN


def expected_score(n: Column) -> tuple[Column, Column]:
    """Mean and spread of the score of n chance matches."""
    ln = F.log(n.cast("double"))
    few = n < FIT_BREAK
    mean = F.when(few, FIT_C * ln * ln + FIT_D * ln + FIT_E).otherwise(_SLOPE * ln + _OFFSET)
    spread = F.when(few, FIT_F * ln + FIT_G).otherwise(F.lit(FIT_F * _LN + FIT_G))
    return mean, spread


def chance_probability(z: Column) -> Column:
    """Probability of a score at least z spreads above the mean by chance."""
    return F.when(z < LEADING_TERM_FROM, 1 - F.exp(-F.exp(-z))).otherwise(F.exp(-z))


def _score_sums() -> list[Column]:
    """Score parts from residue rows (d2, gap): closeness of the matches less the price of the gaps."""
    closeness = F.sum(SCORE_WEIGHT / (1 + F.col("d2") / SCORE_SCALE))
    return [
        F.count(F.lit(1)).alias("n"), F.sum("gap").alias("gaps"),
        (closeness - GAP_PRICE * F.sum("gap")).alias("s_str"),
    ]


def alignment_score(points: DataFrame, keys: list[str], main_atom: int = 0) -> DataFrame:
    """Score row per alignment in its current orientation, from matched points.

    A residue counts with its atom number ``main_atom``.  Columns: n, gaps, s_str, mu_str, delta_str, z_str, p_str.
    """
    main = points.filter(F.col("q") == main_atom)
    return with_probability(distances(main, keys).groupBy(*keys).agg(*_score_sums()))


def with_probability(scored: DataFrame) -> DataFrame:
    """Add mu_str, delta_str, z_str and p_str to rows with n and s_str."""
    mean, spread = expected_score(F.col("n"))
    out = scored.withColumns({"mu_str": mean, "delta_str": spread})
    out = out.withColumn("z_str", (F.col("s_str") - F.col("mu_str")) / F.col("delta_str"))
    return out.withColumn("p_str", chance_probability(F.col("z_str")))


def alignment_stats(points: DataFrame, keys: list[str], optimize: bool = True, main_atom: int = 0) -> DataFrame:
    """One row per alignment: ssd, rmsd, max_dist, n, gaps and score columns.

    With ``optimize`` b is first superimposed on a by the matches, else taken as it stands.  The rmsd is over all atoms;
    distance and score of a residue pair are those of its atom number ``main_atom``.
    """
    coordinates = [s + v for s in "ab" for v in "xyz"]
    gathered = points.groupBy(*keys).agg(
        *(moment_sums(side("a"), side("b")) if optimize else []),
        F.array_sort(F.collect_list(F.struct("k", "q", "gap", *coordinates))).alias("_rows"),
    )
    # An alignment stays one row from here on: its transform is found once and its sums run over the array in order.
    fitted = gathered.select(*keys, "_rows", (fitted_transform() if optimize else identity()).alias("m"))

    def apart(r: Column) -> Column:
        a, b = ([r[s + v] for v in "xyz"] for s in "ab")
        return squared_distance(a, transformed(F.col("m"), b))

    measured = fitted.select(*keys, F.transform(
        "_rows", lambda r: F.struct(r["q"].alias("q"), r["gap"].alias("gap"), apart(r).alias("d2"))).alias("_all"))
    measured = measured.withColumn("_main", F.filter("_all", lambda r: r["q"] == main_atom))
    total = lambda rows, value: F.aggregate(rows, F.lit(0.0), lambda s, r: s + value(r))
    gaps = F.aggregate("_main", F.lit(0).cast("long"), lambda s, r: s + r["gap"])
    closeness = total("_main", lambda r: SCORE_WEIGHT / (1 + r["d2"] / SCORE_SCALE))
    ssd = total("_all", lambda r: r["d2"])
    return with_probability(measured.select(
        *keys, ssd.alias("ssd"), F.sqrt(ssd / F.size("_all")).alias("rmsd"),
        F.sqrt(F.array_max(F.transform("_main", lambda r: r["d2"]))).alias("max_dist"),
        F.size("_main").cast("long").alias("n"), gaps.alias("gaps"), (closeness - GAP_PRICE * gaps).alias("s_str"),
    ))


def solution_profile(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Plot rows per match count: n, rmsd, max_dist and -log10 of the probability (0 if it is 0)."""
    strength = F.when(F.col("p_str") == 0, F.lit(0.0)).otherwise(-F.log10("p_str"))
    return stats.select(*keys, "n", "rmsd", "max_dist", strength.alias("strength"), "s_str", "mu_str", "delta_str", "z_str")

"""Least-squares superposition of match sets and distances between matched points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandfold.functions import geometry as G


def side(prefix: str) -> list:
    return [F.col(f"{prefix}{v}") for v in "xyz"]


def matched_points(matches: DataFrame, paired: DataFrame, atoms_per_residue: int = 1) -> DataFrame:
    """Coordinates of both residues of every match, one row per match and atom.

    ``matches`` is (pair_id, k, i, j) plus any further columns; ``paired`` comes from
    ``attach_chains``.  The match rows of a pair are as few as its residues, so the long side is
    grouped once by pair and the packed chains are read by index.  ``gap`` is 1 where a match does not
    directly continue the one before on both chains.
    """
    extra = [c for c in matches.columns if c not in ("pair_id", "k", "i", "j")]
    keys = ["pair_id", *extra]
    grouped = matches.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "i", "j"))).alias("ms"))
    joined = grouped.join(paired, "pair_id")
    before = lambda at: F.try_element_at("ms", at)  # 1-based, so this is the match before number at
    broken = lambda m, at: (m["i"] > before(at)["i"] + 1) | (m["j"] > before(at)["j"] + 1)
    listed = F.transform("ms", lambda m, at: F.struct(
        m["k"].alias("k"), m["i"].alias("i"), m["j"].alias("j"),
        F.when((at > 0) & broken(m, F.greatest(at, F.lit(1))), 1).otherwise(0).alias("gap"),
    ))
    rows = joined.select(*keys, F.explode(listed).alias("m"), *[s + v for s in "ab" for v in "xyz"])
    if atoms_per_residue > 1:
        rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(atoms_per_residue - 1))))
    else:
        rows = rows.withColumn("q", F.lit(0))
    at = {s: F.col(f"m.{v}") * atoms_per_residue + F.col("q") for s, v in (("a", "i"), ("b", "j"))}
    return rows.select(
        *keys, "m.k", "m.i", "m.j", "m.gap", "q",
        *[F.col(s + v)[at[s]].alias(s + v) for s in "ab" for v in "xyz"],
    )


def listed_points(solutions: DataFrame, paired: DataFrame, keys: list[str], atoms_per_residue: int = 1) -> DataFrame:
    """Coordinates of both residues of every match of solutions (pair_id, *keys, matches), one row per match and atom.

    The matches of a solution are a list already, so nothing but the solution is exchanged, and the sums of a solution are
    made where it meets its chains.
    """
    listed = solutions.select("pair_id", *keys, "matches").join(paired, "pair_id")
    rows = listed.select("pair_id", *keys, F.explode("matches").alias("p"), *[s + v for s in "ab" for v in "xyz"])
    q = F.lit(0)
    if atoms_per_residue > 1:
        rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(atoms_per_residue - 1))))
        q = F.col("q")
    at = {s: F.col(f"p.{v}") * atoms_per_residue + q for s, v in (("a", "i"), ("b", "j"))}
    return rows.select("pair_id", *keys, *[F.col(s + v)[at[s]].alias(s + v) for s in "ab" for v in "xyz"])


def match_moments(points: DataFrame, keys: list[str]) -> DataFrame:
    """The sums a superposition needs, one partial + final aggregation."""
    return points.groupBy(*keys).agg(*G.moment_sums(side("a"), side("b")))


def superpose(points: DataFrame, keys: list[str], transform: bool = False) -> DataFrame:
    """Least RMSD of every match set and, on request, the transform of b that reaches it."""
    fitted = G.with_min_ssd(match_moments(points, keys))
    out = fitted.withColumn("rmsd", G.rmsd(F.col("ssd"), F.col("cnt")))
    cols = [*keys, F.col("cnt").cast("long").alias("n_atoms"), "ssd", "rmsd"]
    if transform:
        cols.append(G.fitted_transform().alias("m"))
    return out.select(*cols)


def move_points(points: DataFrame, m: str = "m") -> DataFrame:
    """Move the b side of matched points by the transform in column ``m``."""
    bx, by, bz = G.transformed(F.col(m), side("b"))
    return points.withColumns({"bx": bx, "by": by, "bz": bz})


def apply_transform(points: DataFrame, m: str = "m") -> DataFrame:
    """Move plain points (x, y, z) by the transform in column ``m``."""
    x, y, z = G.transformed(F.col(m), [F.col(v) for v in "xyz"])
    return points.withColumns({"x": x, "y": y, "z": z})


def distances(points: DataFrame, keys: list[str]) -> DataFrame:
    """Residue-level squared distances: the sum over the atoms of a residue pair."""
    d2 = G.squared_distance(side("a"), side("b"))
    return points.groupBy(*keys, "k", "i", "j", "gap").agg(
        F.sum(d2).alias("d2"), F.count(F.lit(1)).alias("atoms")
    )


def alignment_rmsd(points: DataFrame, keys: list[str]) -> DataFrame:
    """SSD and RMSD of the matches in the orientation given."""
    d2 = G.squared_distance(side("a"), side("b"))
    return points.groupBy(*keys).agg(
        F.sum(d2).alias("ssd"), F.sqrt(F.sum(d2) / F.count(F.lit(1))).alias("rmsd")
    )


def furthest_pair(points: DataFrame, keys: list[str], main_atom: int = 0) -> DataFrame:
    """Largest distance over the matched residues, by atom number ``main_atom``, and where it is (first match on ties)."""
    worst = F.max(F.struct(F.col("d2"), -F.col("i"), -F.col("j"))).alias("w")
    main = points.filter(F.col("q") == main_atom)
    return distances(main, keys).groupBy(*keys).agg(worst).select(
        *keys, F.sqrt("w.d2").alias("max_dist"),
        (-F.col("w.col2")).alias("i"), (-F.col("w.col3")).alias("j"),
    )


def structure_pairs(structures: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested comparisons (a, b) whose two structures both exist, with a stable pair id.

    The work list is an input, as two files are for a single comparison; all-against-all pairing of a
    large collection is deliberately not offered.
    """
    ids = structures.select("structure_id").distinct()
    return (
        requests.join(ids.withColumnRenamed("structure_id", "a"), "a", "left_semi")
        .join(ids.withColumnRenamed("structure_id", "b"), "b", "left_semi")
    )

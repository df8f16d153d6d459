"""Comparison of two alignments of the same structures, for any number of cases at once.

Match sets stay in long form: every metric is a partial aggregation over keys that include the match
or the residue, so a case with a huge number of pairs is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandfold.functions import geometry as G
from strandfold.functions.skew import spread_join


def _tagged(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Membership of every distinct (keys, columns) tuple in both inputs: columns inl, inr."""
    parts = [
        df.select(*keys, *columns, F.lit(l).alias("inl"), F.lit(r).alias("inr"))
        for df, l, r in ((left, 1, 0), (right, 0, 1))
    ]
    return parts[0].unionByName(parts[1]).groupBy(*keys, *columns).agg(
        F.max("inl").alias("inl"), F.max("inr").alias("inr")
    )


def _counts(tagged: DataFrame, keys: list[str], names: tuple[str, str, str]) -> DataFrame:
    left, right, both = names
    return tagged.groupBy(*keys).agg(
        F.sum("inl").alias(left), F.sum("inr").alias(right), F.sum(F.col("inl") * F.col("inr")).alias(both)
    )


def pair_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Shared pairs: n_left, n_right, e_both (E), e_either (e), e_ratio (E/e), e_share (E/N)."""
    df = _counts(_tagged(left, right, keys, ["i", "j"]), keys, ("n_left", "n_right", "e_both"))
    df = df.withColumn("e_either", F.col("n_left") + F.col("n_right") - F.col("e_both"))
    return df.withColumns({
        "e_ratio": F.try_divide(F.col("e_both").cast("double"), F.col("e_either").cast("double")),
        "e_share": F.try_divide(
            F.col("e_both").cast("double"), F.greatest("n_left", "n_right").cast("double")
        ),
    })


def residue_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Residues matched in both and in either alignment, per chain: ra_both, ra_either, rb_*."""
    sides = lambda df: df.select(
        *keys, F.explode(F.array(
            F.struct(F.lit("a").alias("side"), F.col("i").alias("pos")),
            F.struct(F.lit("b").alias("side"), F.col("j").alias("pos")),
        )).alias("r")
    ).select(*keys, "r.side", "r.pos")
    tagged = _tagged(sides(left), sides(right), keys, ["side", "pos"])
    when = lambda side, value: F.sum(F.when(F.col("side") == side, value).otherwise(0))
    both, either = F.col("inl") * F.col("inr"), F.greatest("inl", "inr")
    return tagged.groupBy(*keys).agg(
        when("a", both).alias("ra_both"), when("a", either).alias("ra_either"),
        when("b", both).alias("rb_both"), when("b", either).alias("rb_either"),
    )


def compare_alignments(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All set metrics per case, pairs and residues.

    r_ratio = R/r over both chains, r_share = R/2N, ra_ratio and rb_ratio one-sided.
    """
    df = pair_overlap(left, right, keys).join(residue_overlap(left, right, keys), keys)
    d = lambda c: c.cast("double")
    both = F.col("ra_both") + F.col("rb_both")
    return df.withColumns({
        "r_ratio": F.try_divide(d(both), d(F.col("ra_either") + F.col("rb_either"))),
        "r_share": F.try_divide(d(both), d(2 * F.greatest("n_left", "n_right"))),
        "ra_ratio": F.try_divide(d(F.col("ra_both")), d(F.col("ra_either"))),
        "rb_ratio": F.try_divide(d(F.col("rb_both")), d(F.col("rb_either"))),
    })


def common_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs of both alignments."""
    return left.select(*keys, "i", "j").intersect(right.select(*keys, "i", "j"))


def sequence_conflicts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Cases whose two alignments do not carry the same sequences: (keys, label, left_seq, right_seq)."""
    joined = left.select(*keys, "label", F.col("seq").alias("left_seq")).join(
        right.select(*keys, "label", F.col("seq").alias("right_seq")), [*keys, "label"], "full_outer"
    )
    return joined.filter(~F.col("left_seq").eqNullSafe(F.col("right_seq")))


def displacement(first: Column, second: Column, w: Column) -> Column:
    """RMS displacement of the points behind the second-moment sums ``w`` between two transforms."""
    return F.sqrt(G.displacement_ssd(first, second, w) / w["w33"])


def displacement_moments(points_b: DataFrame, keys: list[str]) -> DataFrame:
    terms = G.second_moments([F.col(v) for v in "xyz"])
    sums = points_b.groupBy(*keys).agg(*[F.sum(v).alias(name) for name, v in terms.items()])
    return sums.select(*keys, F.struct(*terms).alias("w"))


def spatial_displacement(
    fits_left: DataFrame, fits_right: DataFrame, points_b: DataFrame, keys: list[str], out: str = "d3"
) -> DataFrame:
    """RMS displacement of the given b points between the superpositions of two alignments.

    ``fits_*`` carry the transforms (keys, m); ``points_b`` (keys, x, y, z) are all points of b, or
    those matched in both or in either alignment.  A case without points gives no row.
    """
    both = fits_left.select(*keys, F.col("m").alias("_ml")).join(
        fits_right.select(*keys, F.col("m").alias("_mr")), keys
    )
    return both.join(displacement_moments(points_b, keys), keys).select(
        *keys, displacement(F.col("_ml"), F.col("_mr"), F.col("w")).alias(out)
    )


def matched_b(left: DataFrame, right: DataFrame, keys: list[str], which: str) -> DataFrame:
    """Residues of b matched in "both" or "either" alignment: (keys, pos)."""
    tagged = _tagged(
        left.select(*keys, F.col("j").alias("pos")), right.select(*keys, F.col("j").alias("pos")), keys, ["pos"]
    )
    kept = tagged.filter("inl = 1 and inr = 1") if which == "both" else tagged
    return kept.select(*keys, "pos")


def direct_displacement(transforms: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Sum of squared displacements point by point: (transforms columns, ssd).

    ``transforms`` (key, o_id, m1, m2); ``points`` (key, x, y, z).
    """
    grouped = points.groupBy(key).agg(F.collect_list(F.struct("x", "y", "z")).alias("ps"))
    p = [F.col(f"p.{v}") for v in "xyz"]
    joined = spread_join(transforms, grouped, key, ["o_id"]).select("*", F.explode("ps").alias("p"))
    moved = [G.transformed(F.col(m), p) for m in ("m1", "m2")]
    return joined.groupBy(key, "o_id").agg(F.sum(G.squared_distance(*moved)).alias("ssd"))

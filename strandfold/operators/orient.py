"""Candidate orientations: fragment pairs, interval pairs, known matches, given transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandfold.functions import geometry as G
from strandfold.session import task_count

BLOCK = 256


def band_limits(n_min: Column, na: Column, nb: Column) -> tuple[Column, Column]:
    """Least and greatest j - i of a residue pair that can be part of n_min ordered matches."""
    return -(na - n_min), nb - n_min


def fragment_starts(paired: DataFrame, length: int, n_min: Column | int = 1) -> DataFrame:
    """All fragment starts (i0, j0) of both chains inside the diagonal band, without a shuffle."""
    if length < 3:
        raise ValueError("a fragment needs at least 3 residues")
    n_min = n_min if isinstance(n_min, Column) else F.lit(n_min)
    low, high = band_limits(n_min, F.col("na"), F.col("nb"))
    rows = paired.filter((F.col("na") >= length) & (F.col("nb") >= length)).withColumn(
        "i0", F.explode(F.sequence(F.lit(0), F.col("na") - length))
    )
    # the pair (i0+t, j0+t) has the same j - i for every t
    first = F.greatest(F.lit(0), F.col("i0") + low)
    last = F.least(F.col("nb") - length, F.col("i0") + high)
    return rows.withColumn(
        "j0", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))
    )


def rectangle_starts(
    paired: DataFrame, rectangles: DataFrame, length: int, n_min: Column | int = 1
) -> DataFrame:
    """Fragment starts inside any of the (pair_id, a_first, a_last, b_first, b_last) rectangles.

    The bounds are the first and last residue a fragment may use.  Overlapping rectangles give a
    start only once.
    """
    n_min = n_min if isinstance(n_min, Column) else F.lit(n_min)
    low, high = band_limits(n_min, F.col("na"), F.col("nb"))
    boxed = rectangles.join(paired.select("pair_id", "na", "nb"), "pair_id")
    i_last = F.least(F.col("a_last"), F.col("na") - 1) - (length - 1)
    boxed = boxed.filter(i_last >= F.col("a_first")).withColumn(
        "i0", F.explode(F.sequence(F.col("a_first"), i_last))
    )
    first = F.greatest(F.col("b_first"), F.col("i0") + low)
    last = F.least(F.least(F.col("b_last"), F.col("nb") - 1) - (length - 1), F.col("i0") + high)
    return (
        boxed.filter(first <= last).withColumn("j0", F.explode(F.sequence(first, last)))
        .select("pair_id", "i0", "j0").dropDuplicates()
    )


def fragment_moments(starts: DataFrame, length: int, atoms_per_residue: int = 1) -> DataFrame:
    """Superposition sums of every fragment pair, unrolled over its atoms into plain arithmetic.

    Needs the packed chains of the pair on the row, so nothing is shuffled or joined.
    """
    width = length * atoms_per_residue
    start = {"a": F.col("i0") * atoms_per_residue, "b": F.col("j0") * atoms_per_residue}
    read = starts.select(
        "pair_id", "na", "nb", "i0", "j0",
        *[
            G.certain(F.col(s + v)[start[s] + t]).alias(f"_{s}{v}{t}")
            for t in range(width) for s in "ab" for v in "xyz"
        ],
    )
    terms: dict[str, list[Column]] = {}
    for t in range(width):
        a, b = ([F.col(f"_{s}{v}{t}") for v in "xyz"] for s in "ab")
        for name, term in G.moment_terms(a, b).items():
            terms.setdefault(name, []).append(term)
    return read.select(
        "pair_id", "na", "nb", "i0", "j0", *[G.total(v).alias(k) for k, v in terms.items()]
    )


def fragment_fits(
    starts: DataFrame, length: int, max_frag_rmsd: float | None = None, atoms_per_residue: int = 1
) -> DataFrame:
    """RMSD of the best superposition of every fragment pair: (pair_id, o_id, i0, j0, frag_rmsd, ...)."""
    sums = fragment_moments(starts, length, atoms_per_residue)
    # A coalesce to the number of partitions there are already moves nothing; it ends the fused stage,
    # and both halves stay below the size the JVM compiles (see ``attach_chains`` for the partitions).
    sums = sums.coalesce(task_count(starts.sparkSession))
    fitted = G.with_min_ssd(sums, "frag_ssd")
    fitted = fitted.withColumn("frag_rmsd", G.rmsd(F.col("frag_ssd"), F.col("cnt")))
    if max_frag_rmsd is not None:
        fitted = fitted.filter(F.col("frag_rmsd") <= max_frag_rmsd)
    o_id = F.col("i0").cast("long") * F.col("nb") + F.col("j0")
    return fitted.withColumn("o_id", o_id)


def fragment_orientations(
    starts: DataFrame, length: int, max_frag_rmsd: float | None = None, atoms_per_residue: int = 1
) -> DataFrame:
    """Orientations that superimpose a fragment of b on a fragment of a."""
    return fragment_fits(starts, length, max_frag_rmsd, atoms_per_residue).select(
        "pair_id", "o_id", F.lit("fragment").alias("source"), "i0", "j0",
        G.fitted_transform().alias("m"), "frag_rmsd",
    )


def last_fragment_block(block: int = BLOCK) -> Column:
    """Number of the last orientation block of a pair, known from the chain lengths alone."""
    return F.floor((F.col("na").cast("long") * F.col("nb") - 1) / block)


UNIT = 512  # fragment starts of one work unit
CHAINS = [s + v for s in "ab" for v in "xyz"]


def _tiles() -> tuple[Column, Column, Column]:
    """Rows and columns of fragment starts in one unit of a pair, and units side by side."""
    starts = F.col("nb") - F.col("_length") + 1
    wide = F.least(starts, F.lit(UNIT))
    return F.greatest(F.floor(F.lit(UNIT) / wide), F.lit(1)).cast("int"), wide.cast("int"), F.ceil(starts / wide).cast("int")


def work_units(
    paired: DataFrame, length: int, n_min: Column | int = 1, rectangles: DataFrame | None = None
) -> DataFrame:
    """Fragment starts of every pair cut into units of about ``UNIT``, from the chain lengths alone.

    A unit is (pair_id, unit, na, nb, i_from, i_to, j_from, j_to, d_lo, d_hi, boxes, chains): a rectangle of starts inside
    the diagonal band, with the packed chains.  Whatever the fits cost, no pair is tied to one task, and nothing is shuffled.
    ``rectangles`` (pair_id, a_first, a_last, b_first, b_last: first and last residue a fragment may use) keep the units they
    touch; they are clipped to the unit, where overlapping ones count a start once.
    """
    if length < 3:
        raise ValueError("a fragment needs at least 3 residues")
    n_min = n_min if isinstance(n_min, Column) else F.lit(n_min)
    low, high = band_limits(n_min, F.col("na"), F.col("nb"))
    sized = paired.withColumns({"_length": F.lit(length), "d_lo": low, "d_hi": high})
    sized = sized.filter((F.col("na") >= length) & (F.col("nb") >= length))
    down, wide, across = _tiles()
    sized = sized.withColumns({"_down": down, "_wide": wide, "_across": across})
    last = F.col("na") - length
    ends = {"i_to": F.least(F.col("i_from") + F.col("_down"), last + 1),
            "j_to": F.least(F.col("j_from") + F.col("_wide"), F.col("nb") - length + 1)}
    corner = {"i_from": (F.floor(F.col("unit") / F.col("_across")) * F.col("_down")).cast("int"),
              "j_from": (F.col("unit") % F.col("_across") * F.col("_wide")).cast("int")}
    empty = {"o_ids": F.lit(None).cast("array<bigint>"), "ms": F.lit(None).cast("array<double>"),
             "wanted": F.lit(None).cast("array<bigint>")}
    inside = (F.col("j_to") - 1 - F.col("i_from") >= F.col("d_lo")) & (F.col("j_from") - F.col("i_to") + 1 <= F.col("d_hi"))
    columns = ["pair_id", "unit", "na", "nb", *corner, *ends, "d_lo", "d_hi", "boxes", *empty, *CHAINS]
    if rectangles is None:
        rows = (F.floor(last / F.col("_down")) + 1) * F.col("_across")
        units = sized.withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), rows.cast("long") - 1)))
        units = units.withColumns(corner).withColumns(ends).filter(inside)
        return units.withColumns({"boxes": F.lit(None).cast("array<int>"), **empty}).select(columns)
    small = sized.select("pair_id", "na", "nb", "d_lo", "d_hi", "_down", "_wide", "_across")
    boxed = rectangles.select("pair_id", "a_first", "a_last", "b_first", "b_last").join(small, "pair_id")
    boxed = boxed.withColumns({
        "_i": F.greatest("a_first", F.lit(0)), "_k": F.least(F.col("a_last"), F.col("na") - 1) - length + 1,
        "_j": F.greatest("b_first", F.lit(0)), "_l": F.least(F.col("b_last"), F.col("nb") - 1) - length + 1,
    }).filter((F.col("_i") <= F.col("_k")) & (F.col("_j") <= F.col("_l")))
    over = lambda c, step: F.floor(F.col(c) / F.col(step)).cast("long")
    boxed = boxed.withColumn("_r", F.explode(F.sequence(over("_i", "_down"), over("_k", "_down"))))
    boxed = boxed.withColumn("_c", F.explode(F.sequence(over("_j", "_wide"), over("_l", "_wide"))))
    boxed = boxed.withColumn("unit", F.col("_r") * F.col("_across") + F.col("_c")).withColumns(corner).withColumns(ends)
    clipped = F.array(F.greatest("_i", "i_from"), F.least(F.col("_k"), F.col("i_to") - 1),
                      F.greatest("_j", "j_from"), F.least(F.col("_l"), F.col("j_to") - 1))
    # distinct clipped rectangles are bounded by the size of a unit, whatever the number of rectangles
    found = boxed.filter(inside).groupBy("pair_id", "unit").agg(F.flatten(F.collect_set(clipped)).alias("boxes"))
    units = found.join(sized, "pair_id").withColumns(corner).withColumns(ends)
    return units.withColumns(empty).select(columns)


def given_units(orientations: DataFrame, paired: DataFrame, first_unit: int = 0) -> DataFrame:
    """Given orientations (pair_id, o_id, m) as work units of at most ``UNIT``, in the columns of ``work_units``."""
    place = F.row_number().over(Window.partitionBy("pair_id").orderBy("o_id")) - 1
    numbered = orientations.withColumn("unit", F.floor(place / UNIT) + first_unit)
    packed = numbered.groupBy("pair_id", "unit").agg(F.array_sort(F.collect_list(F.struct("o_id", "m"))).alias("os"))
    none = {c: F.lit(None).cast("int") for c in ("i_from", "j_from", "i_to", "j_to", "d_lo", "d_hi")}
    units = packed.join(paired, "pair_id").withColumns({
        **none, "boxes": F.lit(None).cast("array<int>"), "wanted": F.lit(None).cast("array<bigint>"),
        "o_ids": F.col("os.o_id"), "ms": F.flatten("os.m")})
    return units.select("pair_id", "unit", "na", "nb", *none, "boxes", "o_ids", "ms", "wanted", *CHAINS)


def orientations_from_transforms(transforms: DataFrame) -> DataFrame:
    """Given transforms (pair_id, o_id, m) as orientations."""
    return transforms.select(
        "pair_id", F.col("o_id").cast("long").alias("o_id"), F.lit("matrix").alias("source"),
        F.lit(None).cast("int").alias("i0"), F.lit(None).cast("int").alias("j0"),
        "m", F.lit(None).cast("double").alias("frag_rmsd"),
    )


def orientations_from_matches(fits: DataFrame) -> DataFrame:
    """Orientations that superimpose known matches; ``fits`` is superpose(..., transform=True)."""
    return fits.select(
        "pair_id", F.col("o_id").cast("long").alias("o_id"), F.lit("matches").alias("source"),
        F.lit(None).cast("int").alias("i0"), F.lit(None).cast("int").alias("j0"),
        "m", F.col("rmsd").alias("frag_rmsd"),
    )


def with_default(orientations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add the identity for every pair no source gave an orientation for."""
    missing = pairs.select("pair_id").join(orientations.select("pair_id"), "pair_id", "left_anti")
    default = missing.select(
        "pair_id", F.lit(0).cast("long").alias("o_id"), F.lit("identity").alias("source"),
        F.lit(None).cast("int").alias("i0"), F.lit(None).cast("int").alias("j0"),
        G.identity().alias("m"), F.lit(None).cast("double").alias("frag_rmsd"),
    )
    return orientations.unionByName(default)

"""Counts of residue pairs over many alignments and simple value histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandfold.functions import geometry as G


def pair_histogram(matches: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """How many alignments match (i, j): per rank and, with rank NULL, over all ranks."""
    return (
        matches.groupingSets([[key, rank, "i", "j"], [key, "i", "j"]], key, rank, "i", "j")
        .agg(F.count(F.lit(1)).alias("alignments")).select(key, rank, "i", "j", "alignments")
    )


def dense_rows(counts: DataFrame, sizes: DataFrame, keys: list[str], size_key: str) -> DataFrame:
    """Histogram as one text row per residue of a, zeros included: (keys, i, line).

    ``sizes`` is (size_key, na, nb).  Rows are as long as chain b, so a map per row is enough.
    """
    rows = counts.groupBy(*keys, "i").agg(
        F.map_from_entries(F.collect_list(F.struct("j", "alignments"))).alias("cells")
    )
    grid = counts.select(*keys).distinct().join(sizes, size_key).select(
        *keys, "nb", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i")
    )
    cell = lambda j: F.coalesce(F.try_element_at("cells", j), F.lit(0)).cast("string")
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), cell), " ")
    return grid.join(rows, [*keys, "i"], "left").select(*keys, "i", line.alias("line"))


def pair_best_score(matches: DataFrame, key: str, n_from: int = 30) -> DataFrame:
    """Least chance probability of any alignment with at least ``n_from`` matches, per pair (i, j)."""
    return matches.filter(F.col("n") >= n_from).groupBy(key, "i", "j").agg(F.min("p_str").alias("p_best"))


def histogram(values: DataFrame, value: str, low: float, high: float, bins: int, keys: list[str] | None = None) -> DataFrame:
    """Counts in equal bins over [low, high); values outside are not counted."""
    keys = keys or []
    v = F.col(value)
    bin_ = F.floor((v - low) / (high - low) * bins).cast("int")
    inside = values.filter((v >= low) & (v < high))
    return inside.groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("values"))


# From this length of the shorter chain on, neighbouring cells hold fewer candidates than the table of all pairs.
GRID_FROM = 64


def pair_distances(
    paired: DataFrame, n_min: Column | int = 1, max_dist: float | None = None, grid_from: int = GRID_FROM
) -> DataFrame:
    """Squared distance of every residue pair inside the band, or of those within ``max_dist``: (pair_id, i, j, d2).

    Without a limit the work per pair is the size of its cost table.  With one, residues of long chains only meet in
    neighbouring cells of a grid.
    """
    n_min = n_min if isinstance(n_min, Column) else F.lit(n_min)
    if max_dist is None:
        return _all_distances(paired, n_min)
    short = F.least("na", "nb") < grid_from
    near = _all_distances(paired.filter(short), n_min).filter(F.col("d2") <= max_dist * max_dist)
    return near.unionByName(_close_distances(paired.filter(~short), n_min, max_dist))


def _all_distances(paired: DataFrame, n_min: Column) -> DataFrame:
    rows = paired.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
    first = F.greatest(F.lit(0), F.col("i") - (F.col("na") - n_min))
    last = F.least(F.col("nb") - 1, F.col("i") + (F.col("nb") - n_min))
    rows = rows.withColumn(
        "j", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))
    )
    a = [F.col(f"a{v}")[F.col("i")] for v in "xyz"]
    b = [F.col(f"b{v}")[F.col("j")] for v in "xyz"]
    return rows.select("pair_id", "i", "j", G.squared_distance(a, b).alias("d2"))


def _close_distances(paired: DataFrame, n_min: Column, max_dist: float) -> DataFrame:
    """Pairs within a distance by a hash join on (pair, cell): cells are as wide as the distance, and a residue of b is
    copied to the 27 cells around its own."""
    cells = ["pair_id", "cx", "cy", "cz"]
    cell = lambda s, v: F.floor(F.col(f"p.{s}{v}") / max_dist)
    points = {s: paired.select(
        "pair_id", "na", "nb", n_min.alias("_n_min"), F.posexplode(F.arrays_zip(*[f"{s}{v}" for v in "xyz"])).alias(at, "p"))
        for s, at in (("a", "i"), ("b", "j"))}
    a = points["a"].select(
        "pair_id", "na", "nb", "_n_min", "i", *[F.col(f"p.a{v}") for v in "xyz"], *[cell("a", v).alias(f"c{v}") for v in "xyz"])
    steps = F.array(*[F.struct(*[F.lit(d).alias(f"d{v}") for v, d in zip("xyz", (x, y, z))])
                      for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
    b = points["b"].withColumn("s", F.explode(steps)).select(
        "pair_id", "j", *[F.col(f"p.b{v}") for v in "xyz"], *[(cell("b", v) + F.col(f"s.d{v}")).alias(f"c{v}") for v in "xyz"])
    apart = G.squared_distance([F.col(f"a{v}") for v in "xyz"], [F.col(f"b{v}") for v in "xyz"])
    met = a.join(b, cells).withColumn("d2", apart)
    shift = F.col("j") - F.col("i")
    band = shift.between(-(F.col("na") - F.col("_n_min")), F.col("nb") - F.col("_n_min"))
    return met.filter(band & (F.col("d2") <= max_dist * max_dist)).select("pair_id", "i", "j", "d2")


def distance_extent(paired: DataFrame) -> DataFrame:
    """Least and greatest squared distance between the two chains of a pair."""
    return pair_distances(paired).groupBy("pair_id").agg(
        F.min("d2").alias("d2_min"), F.max("d2").alias("d2_max")
    )

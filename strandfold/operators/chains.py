"""From atom rows to residues, points and packed chains.

A structure is bounded by its text format (five columns of atom serial, four of residue number), so
numbering its residues in one window partition is safe; everything else is a partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandfold.functions import geometry as G
from strandfold.functions.frames import axes_of
from strandfold.functions.skew import HotKeys, hot_keys, spread_join
from strandfold.session import task_count

RES_ID = ["structure_id", "chain_id", "seq_num", "insert_code"]
CA = " CA"


def renumbered(residues: DataFrame) -> DataFrame:
    """Give the remaining residues of every structure consecutive positions in their old order."""
    order = W.partitionBy("structure_id").orderBy("pos")
    return residues.withColumn("pos", (F.row_number().over(order) - 1).cast("int"))


def residues(atoms: DataFrame) -> DataFrame:
    """Residues in order of first appearance among the ATOM rows (HETATM rows do not count)."""
    first = (
        atoms.filter(F.col("record") == "ATOM").groupBy(*RES_ID)
        .agg(F.min(F.struct("line_no", "res_name")).alias("first"))
    )
    return renumbered(
        first.select(*RES_ID, F.col("first.res_name").alias("res_name"), F.col("first.line_no").alias("pos"))
    ).select("structure_id", "pos", "chain_id", "seq_num", "insert_code", "res_name")


def _wanted(atoms: DataFrame, names: list[str]) -> DataFrame:
    """ATOM rows with one of the names, tagged with the index of the name."""
    index = F.create_map(*[F.lit(v) for k, name in enumerate(names) for v in (name, k)])
    kept = atoms.filter((F.col("record") == "ATOM") & F.col("atom_name").isin(names))
    return kept.withColumn("q", F.element_at(index, F.col("atom_name")))


def require_atoms(residues_: DataFrame, atoms: DataFrame, names: list[str]) -> DataFrame:
    """Keep the residues that have every named atom; positions are renumbered."""
    complete = (
        _wanted(atoms, names).groupBy(*RES_ID)
        .agg(F.bit_or(F.expr("shiftleft(1L, q)")).alias("seen"))
        .filter(F.col("seen") == (1 << len(names)) - 1)
    )
    return renumbered(residues_.join(complete, RES_ID, "left_semi"))


def backbone_points(residues_: DataFrame, atoms: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One point per residue and named atom; the first instance in the file wins over alternates."""
    first = (
        _wanted(atoms, names or [CA]).groupBy(*RES_ID, "q")
        .agg(F.min(F.struct("line_no", "x", "y", "z")).alias("p"))
    )
    return first.join(residues_.select("pos", *RES_ID), RES_ID).select(
        "structure_id", "pos", "q", "p.x", "p.y", "p.z"
    )


def packed(points: DataFrame) -> DataFrame:
    """One row per structure: (structure_id, n, xs, ys, zs), points ordered by (pos, q)."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "q", "x", "y", "z")))
    return (
        points.groupBy("structure_id").agg(rows.alias("p"), (F.max("pos") + 1).alias("n"))
        .select("structure_id", "n", *[F.col(f"p.{v}").alias(f"{v}s") for v in "xyz"])
    )


def unpacked(chains: DataFrame, atoms_per_residue: int = 1) -> DataFrame:
    """Points of packed chains, without a shuffle."""
    return chains.select(
        "structure_id", F.posexplode(F.arrays_zip("xs", "ys", "zs")).alias("at", "p")
    ).select(
        "structure_id",
        F.floor(F.col("at") / atoms_per_residue).cast("int").alias("pos"),
        (F.col("at") % atoms_per_residue).alias("q"),
        F.col("p.xs").alias("x"), F.col("p.ys").alias("y"), F.col("p.zs").alias("z"),
    )


def centroid(points: DataFrame, key: str = "structure_id") -> DataFrame:
    return points.groupBy(key).agg(*[F.avg(v).alias(f"c{v}") for v in "xyz"])


def structure_moments(points: DataFrame, key: str = "structure_id") -> DataFrame:
    """Ten second-moment sums per structure, as struct ``w``; ``w33`` is the number of points."""
    terms = G.second_moments([F.col(v) for v in "xyz"])
    sums = points.groupBy(key).agg(*[F.sum(v).alias(name) for name, v in terms.items()])
    return sums.select(key, F.struct(*terms).alias("w"))


def scatter_invariants(moments: DataFrame) -> DataFrame:
    """Centred scatter matrix (unnormalised) with its rotation-free trace, minors and determinant."""
    w, n = F.col("w"), F.col("w.w33")
    s = {
        f"s{r}{c}": w[f"w{r}{c}"] - w[f"w{r}3"] * w[f"w{c}3"] / n
        for r in range(3) for c in range(r, 3)
    }
    df = moments.withColumns(s)
    a, b, c, d, e, f = (F.col(k) for k in ("s00", "s11", "s22", "s01", "s02", "s12"))
    return df.withColumns({
        "trace": a + b + c,
        "minors": a * b - d * d + a * c - e * e + b * c - f * f,
        "determinant": a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e),
    })


def principal_axes(moments: DataFrame) -> DataFrame:
    """Eigenvalues (descending) and axes of the centred scatter matrix of every structure."""
    solved = scatter_invariants(moments).withColumn(
        "axes", axes_of(F.struct("s00", "s01", "s02", "s11", "s12", "s22"))
    )
    keys = [c for c in moments.columns if c != "w"]
    return solved.select(*keys, "axes.*")


def sequences(residues_: DataFrame, codes: Column) -> DataFrame:
    """The letters of every structure in order; a name missing from the dictionary gives its default."""
    rows = F.array_sort(F.collect_list(F.struct("pos", codes.alias("letter"))))
    return residues_.groupBy("structure_id").agg(rows.alias("r")).select(
        "structure_id", F.array_join("r.letter", "").alias("sequence")
    )


def hot_structures(pairs: DataFrame) -> HotKeys:
    """Structures that take part in very many pairs, on either side."""
    return hot_keys(pairs.select(F.explode(F.array("a", "b")).alias("key")))


def pair_sizes(pairs: DataFrame, chains: DataFrame) -> DataFrame:
    """Lengths of both chains of every pair and the largest possible number of matches."""
    size = chains.select("structure_id", "n")
    hot = hot_structures(pairs)
    out = pairs
    for side in "ab":
        renamed = size.select(F.col("structure_id").alias(side), F.col("n").alias(f"n{side}"))
        out = spread_join(out, renamed, side, ["pair_id"], hot)
    return out.withColumn("n_most", F.least("na", "nb")).select("pair_id", "a", "b", "na", "nb", "n_most")


def attach_chains(pairs: DataFrame, chains: DataFrame) -> DataFrame:
    """Pairs with both packed chains: (pair_id, a, b, na, nb, ax, ay, az, bx, by, bz).

    A structure that takes part in very many pairs is split over tasks by ``spread_join``.
    The closing repartition has a fixed number of tasks because each row expands to many fragments:
    AQE would merge the partitions by their small bytes.
    """
    hot = hot_structures(pairs)
    out = pairs.select("pair_id", "a", "b")
    for side in "ab":
        packed_ = chains.select(
            F.col("structure_id").alias(side), F.col("n").alias(f"n{side}"),
            *[F.col(f"{v}s").alias(f"{side}{v}") for v in "xyz"],
        )
        out = spread_join(out, packed_, side, ["pair_id"], hot)
    out = out.select("pair_id", "a", "b", "na", "nb", *[s + v for s in "ab" for v in "xyz"])
    return out.repartition(task_count(pairs.sparkSession), "pair_id")

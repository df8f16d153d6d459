"""Writing solutions and tables for other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandfold.sources.msf import matches_to_aligned, msf_text


def transform_text(m: Column, digits: int = 7) -> Column:
    """A transform as three rows of four numbers."""
    number = lambda k: F.format_string(f"%.{digits}g", m[k])
    return F.concat_ws("\n", *[F.concat_ws(" ", *[number(4 * r + c) for c in range(4)]) for r in range(3)])


def solution_comment(label_b: Column) -> Column:
    """What an exported alignment says about itself: count, rmsd and transform."""
    which = F.when(F.col("rank") == 1, F.lit("best choice")).otherwise(F.format_string("choice %d", "rank"))
    return F.concat(
        F.format_string("%d matched residues, ", "n"), which, F.format_string("\nrmsd %.6g\n\nmoved onto the other chain: ", "rmsd"),
        label_b, F.lit("\n"), transform_text(F.col("m"), 6),
    )


def solution_names() -> Column:
    """align<n> for pairs with a single rank, align<rank>_<n> for the others."""
    only_first = F.max("rank").over(W.partitionBy("pair_id")) == 1
    return F.when(only_first, F.format_string("align%d", "n")).otherwise(F.format_string("align%d_%d", "rank", "n"))


def render_solutions(solutions: DataFrame, sequences: DataFrame, compress: bool = False) -> DataFrame:
    """Alignment documents of solutions: (pair_id, rank, n, name, text).

    ``sequences`` is (pair_id, label_a, label_b, seq_a, seq_b).
    """
    named = solutions.withColumn("name", solution_names()).join(sequences, "pair_id")
    rows = matches_to_aligned(named, compress)
    text = msf_text(solution_comment(F.col("label_b")), F.col("label_a"), F.col("label_b"))
    return rows.select("pair_id", "rank", "n", "name", text.alias("text"))


def export_solutions(documents: DataFrame, path: str) -> None:
    """Write alignment documents as text files below pair_id=/rank=/n= folders."""
    documents.select("pair_id", "rank", "n", "text").write.mode("errorifexists").partitionBy(
        "pair_id", "rank", "n"
    ).text(path)


def export_manifest(solutions: DataFrame, owners: DataFrame, atoms_used: list[str], path: str) -> None:
    """Run description per solution: names of both structures, atom list, n, rmsd."""
    names = F.array(*[F.lit(v) for v in atoms_used])
    solutions.join(owners, "pair_id").select(
        "pair_id", "a", "b", "rank", "n", "rmsd", names.alias("atoms_used")
    ).write.mode("errorifexists").json(path)


def export_transforms(solutions: DataFrame, path: str) -> None:
    """Write one transform file per solution."""
    solutions.select("pair_id", "rank", "n", transform_text(F.col("m")).alias("value")).write.mode(
        "errorifexists"
    ).partitionBy("pair_id", "rank", "n").text(path)


def export_profile(profile: DataFrame, path: str) -> None:
    """Write plot rows as CSV."""
    profile.write.mode("errorifexists").option("header", True).csv(path)


def export_lines(lines: DataFrame, path: str) -> None:
    """Write structure lines in order, one folder per structure."""
    lines.repartition("structure_id").sortWithinPartitions("structure_id", "line_no").select(
        "structure_id", F.col("line").alias("value")
    ).write.mode("errorifexists").partitionBy("structure_id").text(path)

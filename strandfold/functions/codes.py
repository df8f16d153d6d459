"""Residue codes and lists of atom names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Standard residue names and letters.
STANDARD = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G",
    "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S",
    "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
# The three further names the report converter knows.
EXTENDED = {**STANDARD, "ASX": "B", "GLX": "Z", "HYP": "O"}
UNKNOWN = "x"


def letter_of(res_name: Column, codes: dict[str, str] | None = None, unknown: str = UNKNOWN) -> Column:
    """One-letter code of a residue name; a map literal, so no join is needed."""
    codes = STANDARD if codes is None else codes
    table = F.create_map(*[F.lit(v) for pair in sorted(codes.items()) for v in pair])
    return F.coalesce(F.try_element_at(table, F.trim(res_name)), F.lit(unknown))


def name_of(letter: Column, codes: dict[str, str] | None = None) -> Column:
    """Residue name of a one-letter code."""
    codes = STANDARD if codes is None else codes
    table = F.create_map(*[F.lit(v) for name, code in sorted(codes.items()) for v in (code, name)])
    return F.try_element_at(table, letter)


def read_codes(spark: SparkSession, path: str) -> tuple[dict[str, str], str]:
    """A dictionary file (name and letter per line, ``unknown`` for the default) as (codes, default).

    The file is a setting, read whole.
    """
    rows = (r.value.split() for r in spark.read.text(path).collect())
    codes = {r[0]: r[1] for r in rows if len(r) == 2}
    return codes, codes.pop("unknown", UNKNOWN)


def read_atom_names(spark: SparkSession, path: str) -> list[str]:
    """A file with one atom name per line, leading blanks significant."""
    return [r.value.rstrip() for r in spark.read.text(path).collect() if r.value.strip()]


def unknown_residues(residues: DataFrame, codes: dict[str, str] | None = None) -> DataFrame:
    """Residues whose name is not in the dictionary."""
    return residues.filter(~F.trim("res_name").isin(*sorted(STANDARD if codes is None else codes)))

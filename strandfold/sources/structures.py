"""Structure text files: fixed-width records to rows and back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# First column (1-based) and width of the fields of ATOM and HETATM records.
ATOM_FIELDS = {
    "serial": (7, 5), "atom_name": (13, 4), "alt_loc": (17, 1), "res_name": (18, 4), "chain_id": (22, 1),
    "seq_num": (23, 4), "insert_code": (27, 1), "x": (31, 8), "y": (39, 8), "z": (47, 8),
    "occupancy": (55, 6), "temp_factor": (61, 6),
}
# Columns of (chain, number, insert code) of both ends of an interval record.
INTERVAL_FIELDS = {
    "HELIX": ((20, 22, 26), (32, 34, 38)),
    "SHEET": ((22, 23, 27), (33, 34, 38)),
    "TURN": ((20, 21, 25), (31, 32, 36)),
}
# An interval record longer than this is cut; a shorter one must parse as it is.
INTERVAL_WIDTH = 71


def file_id(files: DataFrame) -> Column:
    """File name without its ending, as id; several files of one name are an error, as their rows would mix."""
    names = [re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1]) for path in files.inputFiles()]
    if len(set(names)) < len(names):
        twice = sorted({n for n in names if names.count(n) > 1}) if len(names) < 1000 else "several"
        raise ValueError(f"files of equal name: {twice}")
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def read_structure_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files below ``path``: (structure_id, line_no, line), numbered from 1.

    A structure file is one row first, so line numbers do not depend on how files are split.  Blank lines are lines too;
    only the nothing after the last line end is none.
    """
    files = spark.read.text(path, wholetext=True)
    lines = F.split("value", "\r?\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return files.select(file_id(files).alias("structure_id"), F.posexplode(lines).alias("at", "line")).select(
        "structure_id", (F.col("at") + 1).alias("line_no"), "line"
    )


def record_kind(line: Column) -> Column:
    return F.rtrim(F.substring(line, 1, 6))


def _field(line: Column, start: int, width: int) -> Column:
    return F.substring(line, start, width)


def parse_atoms(lines: DataFrame) -> DataFrame:
    """ATOM and HETATM records as typed rows; trailing blanks of names are cut, leading ones kept."""
    line = F.col("line")
    kind = record_kind(line)
    out = []
    for name, (start, width) in ATOM_FIELDS.items():
        raw = _field(line, start, width)
        if name in ("serial", "seq_num"):
            out.append(F.trim(raw).try_cast("int").alias(name))
        elif name in ("x", "y", "z", "occupancy", "temp_factor"):
            out.append(F.trim(raw).try_cast("double").alias(name))
        elif name in ("alt_loc", "chain_id", "insert_code"):
            out.append(F.rpad(raw, 1, " ").alias(name))
        else:
            out.append(F.rtrim(raw).alias(name))
    return lines.filter(kind.isin("ATOM", "HETATM")).select(
        "structure_id", "line_no", kind.alias("record"), *out
    )


def interval_end(line: Column, kind: Column, end: int) -> dict[str, Column]:
    """Residue id of the first (0) or last (1) end of an interval record, NULL for other records."""
    cut = F.substring(line, 1, INTERVAL_WIDTH)
    out = {}
    for part, (name, width) in enumerate((("chain_id", 1), ("seq_num", 4), ("insert_code", 1))):
        value = F.lit(None).cast("string")
        for record, fields in INTERVAL_FIELDS.items():
            value = F.when(kind == record, _field(cut, fields[end][part], width)).otherwise(value)
        out[name] = F.trim(value).try_cast("int") if name == "seq_num" else F.rpad(value, 1, " ")
    return out


def atom_residue(line: Column) -> dict[str, Column]:
    """Residue id of an atom record."""
    part = {name: _field(line, *ATOM_FIELDS[name]) for name in ("chain_id", "seq_num", "insert_code")}
    return {
        "chain_id": F.rpad(part["chain_id"], 1, " "), "seq_num": F.trim(part["seq_num"]).try_cast("int"),
        "insert_code": F.rpad(part["insert_code"], 1, " "),
    }


def parse_sse(lines: DataFrame, strict: bool = True) -> DataFrame:
    """End points of HELIX, SHEET and TURN records.

    (structure_id, line_no, kind, first_* and last_* chain_id, seq_num, insert_code, valid).  With
    ``strict`` a record without two numbers is an error, else it is kept with valid = false.
    """
    rows = lines.withColumn("kind", record_kind(F.col("line"))).filter(F.col("kind").isin(*INTERVAL_FIELDS))
    columns = [
        value.alias(f"{side}_{name}")
        for end, side in enumerate(("first", "last"))
        for name, value in interval_end(F.col("line"), F.col("kind"), end).items()
    ]
    parsed = rows.select("structure_id", "line_no", "kind", *columns, "line")
    valid = F.col("first_seq_num").isNotNull() & F.col("last_seq_num").isNotNull()
    if strict:
        message = F.concat(F.lit("unsupported interval record: "), F.col("line"))
        valid = F.when(valid, True).otherwise(F.raise_error(message).cast("boolean"))
    return parsed.withColumn("valid", valid).drop("line")


def structure_issues(lines: DataFrame, atoms: DataFrame) -> DataFrame:
    """Problems per structure: several models, residue ids in disjoint places, alternate atoms.

    (structure_id, issue, detail_count); structures without problems give no row.
    """
    models = lines.filter(record_kind(F.col("line")) == "MODEL").groupBy("structure_id").agg(
        F.count(F.lit(1)).alias("detail_count")
    ).filter("detail_count > 1").select("structure_id", F.lit("several models").alias("issue"), "detail_count")
    polymer = atoms.filter("record = 'ATOM'")
    id_ = F.struct("chain_id", "seq_num", "insert_code")
    order = W.partitionBy("structure_id").orderBy("line_no")
    runs = (
        polymer.withColumn("id", id_).withColumn("new", ~F.col("id").eqNullSafe(F.lag("id").over(order)))
        .filter("new").groupBy("structure_id", "id").agg(F.count(F.lit(1)).alias("runs")).filter("runs > 1")
        .groupBy("structure_id").agg(F.count(F.lit(1)).alias("detail_count"))
        .select("structure_id", F.lit("residue id in disjoint places").alias("issue"), "detail_count")
    )
    alternates = polymer.filter("alt_loc <> ' '").groupBy("structure_id").agg(
        F.count(F.lit(1)).alias("detail_count")
    ).select("structure_id", F.lit("alternate atoms").alias("issue"), "detail_count")
    return models.unionByName(runs).unionByName(alternates)


def with_coordinates(line: Column, x: Column, y: Column, z: Column) -> Column:
    """A record line with its three coordinate fields replaced."""
    return F.concat(
        F.rpad(F.substring(line, 1, 30), 30, " "), F.format_string("%8.3f%8.3f%8.3f", x, y, z),
        F.substring(line, F.lit(55), F.length(line)),
    )


def render_atoms(atoms: DataFrame) -> DataFrame:
    """Atom rows as fixed-width record lines: (structure_id, line_no, line)."""
    text = F.format_string(
        "%-6s%5d %-4s%s%-4s%s%4d%s   %8.3f%8.3f%8.3f%6.2f%6.2f",
        "record", "serial", "atom_name", "alt_loc", "res_name", "chain_id", "seq_num", "insert_code",
        "x", "y", "z", F.coalesce("occupancy", F.lit(1.0)), F.coalesce("temp_factor", F.lit(0.0)),
    )
    return atoms.select("structure_id", "line_no", text.alias("line"))


def rotate_structure(lines: DataFrame, transforms: DataFrame) -> DataFrame:
    """Move the ATOM and HETATM records of every structure by its transform (structure_id, m).

    All other lines pass through untouched.
    """
    from strandfold.functions.geometry import transformed

    joined = lines.join(transforms.select("structure_id", "m"), "structure_id")
    at = [F.trim(_field(F.col("line"), *ATOM_FIELDS[v])).try_cast("double") for v in "xyz"]
    moved = with_coordinates(F.col("line"), *transformed(F.col("m"), at))
    is_atom = record_kind(F.col("line")).isin("ATOM", "HETATM")
    return joined.select("structure_id", "line_no", F.when(is_atom, moved).otherwise(F.col("line")).alias("line"))

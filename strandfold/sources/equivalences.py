"""Other text inputs that carry matches or transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# An equivalence line reads
#   k: name1 name2  a - b <=> c - d  (RES [C] no - RES [C] no <=> RES [C] no - RES [C] no)
_ID = r"(\S+)\s+(?:(\S)\s+)?(-?\d+)([^\s\d)]?)"
EQUIVALENCE = (
    r"^\s*\S+\s+(\S+)\s+(\S+)\s+.*?\(\s*"
    + _ID + r"\s+-\s+" + _ID + r"\s+<=>\s+" + _ID + r"\s+-\s+" + _ID
)


def fssp_ranges(docs: DataFrame, first: Column, second: Column) -> DataFrame:
    """Ranges of the equivalence section that concern the labels ``first`` and ``second``.

    (doc_id, at, side pairs of residue ids and names); labels in reverse order are turned round.
    """
    lines = F.split("text", "\r?\n")
    head = F.transform(lines, lambda l: l.rlike(r"^\s*## EQUIVALENCES"))
    begin = F.array_position(head, True).cast("int")
    body = F.when(begin > 0, F.slice(lines, begin + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    rows = docs.select("doc_id", first.alias("la"), second.alias("lb"), F.posexplode(body).alias("at", "line"))
    # the section ends at the next ## line
    stop = docs.select("doc_id", F.array_position(
        F.transform(body, lambda l: l.rlike(r"^\s*##")), True
    ).alias("stop"))
    rows = rows.join(stop, "doc_id").filter((F.col("stop") == 0) | (F.col("at") < F.col("stop") - 1))
    part = lambda k: F.regexp_extract("line", EQUIVALENCE, k)
    names = rows.withColumns({"n1": part(1), "n2": part(2)})
    straight = (F.col("n1") == F.col("la")) & (F.col("n2") == F.col("lb"))
    crossed = (F.col("n1") == F.col("lb")) & (F.col("n2") == F.col("la"))
    kept = names.filter(straight | crossed).withColumn("crossed", ~straight)
    blank = lambda v: F.when(v == "", " ").otherwise(v)
    end = lambda base: F.struct(
        part(base).alias("res_name"), blank(part(base + 1)).alias("chain_id"),
        part(base + 2).cast("int").alias("seq_num"), blank(part(base + 3)).alias("insert_code"),
    )
    ends = kept.select("doc_id", "at", "crossed", *[end(3 + 4 * k).alias(f"e{k}") for k in range(4)])
    pick = lambda k, other: F.when(F.col("crossed"), F.col(f"e{other}")).otherwise(F.col(f"e{k}"))
    return ends.select(
        "doc_id", "at", pick(0, 2).alias("a_first"), pick(1, 3).alias("a_last"),
        pick(2, 0).alias("b_first"), pick(3, 1).alias("b_last"),
    )


def fssp_to_matches(ranges: DataFrame, residues: DataFrame, owners: DataFrame) -> DataFrame:
    """Ranges resolved to positions and expanded to pairs: (doc_id, k, i, j).

    ``owners`` is (doc_id, a, b) with the structure ids of both sides.  An unknown residue, another
    residue name than stated, or ranges of different size are errors.
    """
    out = ranges.join(owners, "doc_id")
    table = residues.select("structure_id", "pos", "res_name", F.struct("chain_id", "seq_num", "insert_code").alias("id"))
    for side in "ab":
        for end in ("first", "last"):
            column = F.col(f"{side}_{end}")
            out = out.withColumn("id", F.struct(column["chain_id"], column["seq_num"], column["insert_code"]))
            found = table.select(
                F.col("structure_id").alias(side), "id", F.col("pos").alias("_pos"), F.col("res_name").alias("_name")
            )
            out = out.join(found, [side, "id"], "left")
            fits = F.col("_name") == column["res_name"]
            message = F.concat(F.lit("residue not found or of another name in "), F.col("doc_id").cast("string"))
            out = out.withColumn(
                f"{side}_{end}_pos", F.when(fits, F.col("_pos")).otherwise(F.raise_error(message).cast("int"))
            ).drop("id", "_pos", "_name")
    size = F.col("a_last_pos") - F.col("a_first_pos")
    same = size == F.col("b_last_pos") - F.col("b_first_pos")
    steps = F.when(same, F.sequence(F.lit(0), size)).otherwise(
        F.raise_error(F.lit("equivalent ranges of different size")).cast("array<int>")
    )
    pairs = out.select("doc_id", "a_first_pos", "b_first_pos", F.explode(steps).alias("t")).select(
        "doc_id", (F.col("a_first_pos") + F.col("t")).alias("i"), (F.col("b_first_pos") + F.col("t")).alias("j")
    ).distinct()
    return numbered(pairs, "doc_id")


def numbered(pairs: DataFrame, key: str) -> DataFrame:
    """Give the pairs of every (chain-bounded) alignment their order number k."""
    ordered = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("ms"))
    return ordered.select(key, F.posexplode("ms").alias("k", "m")).select(key, "k", "m.i", "m.j")


def align_report_pairs(docs: DataFrame) -> DataFrame:
    """Rows of ten tokens after the EQUIV line: (doc_id, a_index, a_name, a_seq, b_index, b_name, b_seq)."""
    lines = F.split("text", "\r?\n")
    begin = F.array_position(F.transform(lines, lambda l: F.substring(l, 1, 5) == "EQUIV"), True).cast("int")
    body = F.when(begin > 0, F.slice(lines, begin + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    tokens = docs.select("doc_id", F.posexplode(
        F.filter(F.transform(body, lambda l: F.split(F.trim(l), r"\s+")), lambda v: F.size(v) == 10)
    ).alias("at", "v"))
    v = lambda k: F.col("v")[k]
    return tokens.select(
        "doc_id", "at", v(1).cast("int").alias("a_index"), v(2).alias("a_name"), v(3).cast("int").alias("a_seq"),
        v(7).cast("int").alias("b_index"), v(8).alias("b_name"), v(9).cast("int").alias("b_seq"),
    )


def align_report_to_matches(pairs: DataFrame) -> DataFrame:
    """Matches of every report: (doc_id, k, i, j); indices in the report count from 1."""
    zero_based = pairs.select("doc_id", (F.col("a_index") - 1).alias("i"), (F.col("b_index") - 1).alias("j"))
    return numbered(zero_based.distinct(), "doc_id")


def align_report_mismatches(pairs: DataFrame, residues: DataFrame, owners: DataFrame) -> DataFrame:
    """Report rows whose residue name differs from the structure: (doc_id, at, side, stated, found)."""
    out = pairs.join(owners, "doc_id")
    checks = []
    for side in "ab":
        named = residues.select(
            F.col("structure_id").alias(side), (F.col("pos") + 1).alias(f"{side}_index"), F.col("res_name").alias("found")
        )
        checks.append(
            out.join(named, [side, f"{side}_index"], "left")
            .filter(~F.col("found").eqNullSafe(F.col(f"{side}_name")))
            .select("doc_id", "at", F.lit(side).alias("side"), F.col(f"{side}_name").alias("stated"), "found")
        )
    return checks[0].unionByName(checks[1])


def parse_transforms(docs: DataFrame) -> DataFrame:
    """Documents of twelve numbers as transforms: (doc_id, m)."""
    words = F.filter(F.split("text", r"\s+"), lambda v: v != "")
    numbers = F.transform(words, lambda v: v.cast("double"))
    twelve = F.when(F.size(numbers) == 12, numbers).otherwise(
        F.raise_error(F.lit("a transform file holds 12 numbers")).cast("array<double>")
    )
    return docs.select("doc_id", twelve.alias("m"))


def read_transforms(spark: SparkSession, path: str) -> DataFrame:
    from strandfold.sources.msf import read_docs

    return parse_transforms(read_docs(spark, path))

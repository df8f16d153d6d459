"""Pairwise alignments as multiple-sequence text: reading, decoding, checking, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandfold.sources.structures import file_id

# Characters that stand for a gap, and the one that is written.
GAP_CLASS = "[.~]"
GAP = "."
ROW_WIDTH = 50
GROUP_WIDTH = 10


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (doc_id, text)."""
    files = spark.read.text(path, wholetext=True)
    return files.select(file_id(files).alias("doc_id"), F.col("value").alias("text"))


def _body_rows() -> Column:
    """Rows after the separator line as structs (label, seq), blanks inside sequences removed."""
    lines = F.split("text", "\r?\n")
    mark = F.array_position(lines, "//")
    body = F.when(
        mark > 0, F.slice(lines, mark.cast("int") + 1, F.size(lines))
    ).otherwise(F.raise_error(F.lit("no line with only // in alignment text")).cast("array<string>"))
    row = r"^\s*(\S+)\s+(\S.*)$"
    return F.transform(
        F.filter(body, lambda l: l.rlike(row)),
        lambda l: F.struct(
            F.regexp_extract(l, row, 1).alias("label"),
            F.regexp_replace(F.regexp_extract(l, row, 2), r"\s+", "").alias("chunk"),
        ),
    )


def read_aligned(docs: DataFrame, labels: Column) -> DataFrame:
    """Aligned strings of the two ``labels`` (array column) of every document: (doc_id, label, seq).

    The rows of the labels must alternate and their strings have equal length; equal labels are told
    apart by their turn.
    """
    rows = docs.select("doc_id", labels.alias("labels"), _body_rows().alias("rows"))
    rows = rows.withColumn("own", F.filter("rows", lambda r: F.array_contains("labels", r["label"])))
    turn = lambda k: F.transform(
        F.filter("own", lambda r, at: at % 2 == k), lambda r: r["label"]
    )
    text = lambda k: F.array_join(F.transform(F.filter("own", lambda r, at: at % 2 == k), lambda r: r["chunk"]), "")
    steady = lambda k: F.forall(turn(k), lambda v: v == F.element_at("labels", k + 1))
    pairs = rows.select(
        "doc_id", F.array(*[
            F.struct(F.lit(k).alias("side"), F.element_at("labels", k + 1).alias("label"), text(k).alias("seq"))
            for k in (0, 1)
        ]).alias("both"), (steady(0) & steady(1)).alias("alternate"),
    )
    equal = F.length(F.col("both")[0]["seq"]) == F.length(F.col("both")[1]["seq"])
    checked = F.when(F.col("alternate") & equal, F.col("both")).otherwise(F.raise_error(
        F.concat(F.lit("labels do not alternate or rows differ in length in "), F.col("doc_id").cast("string"))
    ).cast("array<struct<side:int,label:string,seq:string>>"))
    return pairs.select("doc_id", F.explode(checked).alias("r")).select("doc_id", "r.*")


def msf_sequence(docs: DataFrame, label: Column) -> DataFrame:
    """The ungapped sequence of one label of every document: (doc_id, label, sequence)."""
    chunks = F.transform(F.filter(_body_rows(), lambda r: r["label"] == label), lambda r: r["chunk"])
    return docs.select(
        "doc_id", label.alias("label"), F.regexp_replace(F.array_join(chunks, ""), GAP_CLASS, "").alias("sequence")
    )


def aligned_columns(aligned: DataFrame) -> DataFrame:
    """One row per alignment column: letters and residue numbers on both sides (doc_id, col, ...).

    Residue numbers are running counts of non-gap letters along one alignment, whose length is bound
    by its two chains.
    """
    side = lambda k: aligned.filter(F.col("side") == k).select("doc_id", F.col("seq").alias(f"seq{k}"))
    wide = side(0).join(side(1), "doc_id")
    letters = wide.select("doc_id", F.posexplode(F.arrays_zip(
        F.split("seq0", "").alias("a"), F.split("seq1", "").alias("b")
    )).alias("col", "p")).select("doc_id", "col", F.col("p.a").alias("la"), F.col("p.b").alias("lb"))
    along = W.partitionBy("doc_id").orderBy("col").rowsBetween(W.unboundedPreceding, 0)
    used = lambda c: (~F.col(c).rlike(GAP_CLASS)).cast("int")
    return letters.withColumns({"ua": used("la"), "ub": used("lb")}).withColumns({
        "i": (F.sum("ua").over(along) - 1).cast("int"), "j": (F.sum("ub").over(along) - 1).cast("int"),
    })


def msf_to_matches(aligned: DataFrame, lower_is_unmatched: bool = False) -> DataFrame:
    """Matches of every document: (doc_id, k, i, j); a column with two letters is a match.

    With ``lower_is_unmatched`` a column of lower-case letters is the compressed form of two gaps.
    """
    matched = F.col("ua") * F.col("ub")
    if lower_is_unmatched:
        matched = matched * (~F.col("la").rlike("[a-z]")).cast("int")
    along = W.partitionBy("doc_id").orderBy("col").rowsBetween(W.unboundedPreceding, 0)
    numbered = aligned_columns(aligned).withColumn("m", matched).withColumn("k", (F.sum("m").over(along) - 1).cast("int"))
    return numbered.filter("m = 1").select("doc_id", "k", "i", "j")


def msf_mismatches(aligned: DataFrame, sequences: DataFrame) -> DataFrame:
    """Where the letters of an alignment differ from given sequences (doc_id, side, sequence).

    (doc_id, side, pos, found, expected): pos is NULL for a different length, then found and expected
    are the two lengths.
    """
    plain = aligned.select("doc_id", "side", F.regexp_replace("seq", GAP_CLASS, "").alias("have"))
    both = plain.join(sequences.select("doc_id", "side", F.col("sequence").alias("want")), ["doc_id", "side"])
    lengths = both.filter(F.length("have") != F.length("want")).select(
        "doc_id", "side", F.lit(None).cast("int").alias("pos"),
        F.length("have").cast("string").alias("found"), F.length("want").cast("string").alias("expected"),
    )
    letters = both.filter(F.length("have") == F.length("want")).select(
        "doc_id", "side", F.posexplode(F.arrays_zip(
            F.split(F.upper("have"), "").alias("h"), F.split(F.upper("want"), "").alias("w")
        )).alias("pos", "p"),
    ).filter(F.col("p.h") != F.col("p.w")).select(
        "doc_id", "side", "pos", F.col("p.h").alias("found"), F.col("p.w").alias("expected")
    )
    return letters.unionByName(lengths)


def matches_to_aligned(alignments: DataFrame, compress: bool = False) -> DataFrame:
    """Aligned strings of packed alignments: adds ``row_a`` and ``row_b``.

    Input has ``matches`` (array of (i, j), increasing), ``seq_a`` and ``seq_b``.  Before every match
    the skipped residues of a stand over gaps, then those of b.  With ``compress`` skipped residues
    overlap in lower case, which is only unambiguous, and only done, when all letters are A-Z.
    """
    end = F.struct(F.length("seq_a").alias("i"), F.length("seq_b").alias("j"))
    start = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"))
    stops = F.concat("matches", F.array(end))
    starts = F.concat(F.array(start), F.col("matches"))
    segments = F.arrays_zip(starts.alias("p"), stops.alias("c"))

    plain = F.col("seq_a").rlike("^[A-Z]*$") & F.col("seq_b").rlike("^[A-Z]*$")

    def segment(s, own: str, other: str, own_first: bool):
        seq = F.col("seq_a" if own == "i" else "seq_b")
        skipped = s["c"][own] - s["p"][own] - 1
        opposite = s["c"][other] - s["p"][other] - 1
        shared = F.when(plain, F.least(skipped, opposite)).otherwise(F.lit(0)) if compress else F.lit(0)
        begin = s["p"][own] + 2
        head = F.lower(F.substring(seq, begin, shared))
        rest = F.substring(seq, begin + shared, skipped - shared)
        blank = F.repeat(F.lit(GAP), (opposite - shared).cast("int"))
        match = F.substring(seq, s["c"][own] + 1, F.lit(1))
        parts = [head, rest, blank, match] if own_first else [head, blank, rest, match]
        return F.concat(*parts)

    return alignments.withColumns({
        "row_a": F.array_join(F.transform(segments, lambda s: segment(s, "i", "j", True)), ""),
        "row_b": F.array_join(F.transform(segments, lambda s: segment(s, "j", "i", False)), ""),
    })


def msf_text(comment: Column, label_a: Column, label_b: Column, numbers: bool = False) -> Column:
    """The document for ``row_a`` and ``row_b``: header, names, //, rows of 50 in groups of 10."""
    width = F.greatest(F.length(label_a), F.length(label_b)) + 2
    total = F.length("row_a")
    chunk = lambda row, at: F.trim(F.regexp_replace(
        F.substring(F.col(row), at + 1, F.lit(ROW_WIDTH)), f"(.{{{GROUP_WIDTH}}})", "$1 "
    ))
    line = lambda label, row, at: F.concat(F.rpad(label, width, " "), chunk(row, at))
    ruler = lambda at: F.concat(
        F.repeat(F.lit(" "), width), F.rpad((at + 1).cast("string"), 50, " "),
        F.least(at + ROW_WIDTH, total).cast("string"), F.lit("\n"),
    ) if numbers else F.lit("")
    body = F.transform(
        F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)), F.lit(ROW_WIDTH)),
        lambda at: F.concat(ruler(at), line(label_a, "row_a", at), F.lit("\n"), line(label_b, "row_b", at), F.lit("\n")),
    )
    name = lambda label, seq: F.concat(
        F.lit("Name: "), label, F.lit("  Len: "), F.length(seq).cast("string"), F.lit("   Check: 0   Weight: 1.00\n")
    )
    return F.concat(
        comment, F.lit("\n\n  MSF: "), total.cast("string"), F.lit("  Type: P  Check: 0 ..\n\n"),
        name(label_a, "seq_a"), name(label_b, "seq_b"), F.lit("\n//\n\n"), F.array_join(body, "\n"),
    )

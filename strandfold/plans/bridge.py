"""Chains, residues, pairs and text records that Spark derives from the generic test tables.

``embeddings`` has one vector per row; consecutive triples of it are the steps of a 3-D walk.  The
derivation is row-local, so every derived table grows with the input and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandfold.session import tasks_for_rows

# The one-letter residue codes in alphabetical order and their three-letter names.
LETTERS = "ACDEFGHIKLMNPQRSTVWY"
NAMES = (
    "ALA CYS ASP GLU PHE GLY HIS ILE LYS LEU MET ASN PRO GLN ARG SER THR VAL TRP TYR"
).split()

STEP = 10.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _walk(axis: int) -> str:
    """Prefix sums of every third entry of the vector, starting at ``axis``."""
    return f"""
        slice(aggregate(sequence(0, n - 1),
                  array(0D),
                  (acc, p) -> concat(acc, array(
                      acc[p] + {STEP}D * cast(embedding[3 * p + {axis}] as double)))),
              2, n)"""


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed chains: (structure_id, label, n, xs, ys, zs)."""
    base = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("structure_id"), "label",
        F.expr("cast(floor(size(embedding) / 3) as int)").alias("n"), "embedding",
    )
    return base.select(
        "structure_id", "label", "n",
        *[F.expr(_walk(k)).alias(f"{axis}s") for k, axis in enumerate("xyz")],
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: (structure_id, pos, q, x, y, z)."""
    return chains(spark, sf_dir).select(
        "structure_id", F.posexplode(F.arrays_zip("xs", "ys", "zs")).alias("pos", "p"),
    ).select(
        "structure_id", "pos", F.lit(0).alias("q"),
        F.col("p.xs").alias("x"), F.col("p.ys").alias("y"), F.col("p.zs").alias("z"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested comparisons: every structure against the one with the next id (linear in the data)."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"))
    nxt = ids.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"))
    return ids.join(nxt, "a").select(F.col("a").alias("pair_id"), "a", "b")


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue ids with two chains and one insert code; letters cycle with the structure id.

    Positions 0-11 are chain A (position 4 carries insert code A of number 4), the rest is chain B.
    """
    pos = F.col("pos")
    letter = F.element_at(
        F.array(*[F.lit(v) for v in NAMES]),
        (F.pmod(F.col("structure_id") + pos, F.lit(20)) + 1).cast("int"),
    )
    return chains(spark, sf_dir).select(
        "structure_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"),
    ).select(
        "structure_id", "pos",
        F.when(pos < 12, "A").otherwise("B").alias("chain_id"),
        F.when(pos < 4, pos + 1).when(pos < 12, pos).otherwise(pos - 11).cast("int").alias("seq_num"),
        F.when(pos == 4, "A").otherwise(" ").alias("insert_code"),
        letter.alias("res_name"),
    )


def sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two secondary-structure intervals per chain: (structure_id, kind, first_pos, last_pos)."""
    return chains(spark, sf_dir).select(
        "structure_id",
        F.explode(F.array(
            F.struct(F.lit("HELIX").alias("kind"), F.lit(2).alias("first_pos"), F.lit(7).alias("last_pos")),
            F.struct(F.lit("SHEET").alias("kind"), F.lit(13).alias("first_pos"), F.lit(17).alias("last_pos")),
        )).alias("s"),
    ).select("structure_id", "s.*")


def given_matches(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """A monotone one-to-one match set per pair: (pair_id, k, i, j).

    left:  j = i + a mod 3, leaving out (i + a) mod 5 = 0;  right: j = i + b mod 3, (i + b) mod 4 = 0.
    """
    owner, step = (F.col("a"), 5) if side == "left" else (F.col("b"), 4)
    # the ids are a few bytes a pair, so the rows they become are counted; each may be held some ten times by what follows
    residues = table(spark, sf_dir, "embeddings").agg(F.sum(F.floor(F.size("embedding") / 3))).first()[0]
    tasks = tasks_for_rows(spark, 10 * max(residues or 0, 0))
    base = pairs(spark, sf_dir).join(
        chains(spark, sf_dir).select(F.col("structure_id").alias("a"), "n"), "a"
    ).select(
        "pair_id", F.pmod(owner, F.lit(3)).cast("int").alias("shift"), owner.alias("owner"),
        F.expr("sequence(0, n - 1)").alias("span"), "n",
    ).repartition(tasks, "pair_id")
    return base.select(
        "pair_id",
        F.posexplode(F.filter(
            "span",
            lambda i: (i + F.col("shift") < F.col("n")) & (F.pmod(i + F.col("owner"), F.lit(step)) != 0),
        )).alias("k", "i"), "shift",
    ).select("pair_id", "k", "i", (F.col("i") + F.col("shift")).alias("j"))


def match_sets(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    """Large unordered pair sets from ``lineitem``: (case_id, i, j), distinct."""
    lines = table(spark, sf_dir, "lineitem")
    chosen = lines.filter(F.col("l_linestatus") == status).select(
        F.col("l_suppkey").alias("case_id"),
        F.pmod("l_partkey", F.lit(100)).cast("int").alias("i"),
        F.col("l_quantity").cast("int").alias("j"),
    )
    # rows of three small numbers compress well, so partitions follow their number; the same one for every status
    return chosen.repartition(tasks_for_rows(spark, lines.count()), "case_id", "i", "j").distinct()


def atom_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atom records per residue: N, CA (or CB where the residue lacks a CA), an alternate CA, a water.

    The CA is missing where (structure_id + pos) mod 17 = 0; position 7 has alternates A and B; a
    HETATM shares the id of position 10; every 40th structure repeats its first residue at the end.
    """
    base = residues(spark, sf_dir).join(
        points(spark, sf_dir).select("structure_id", "pos", "x", "y", "z"), ["structure_id", "pos"]
    )
    pos, sid = F.col("pos"), F.col("structure_id")
    atom = lambda record, slot, name, alt, dx: F.struct(
        F.lit(record).alias("record"), F.lit(slot).alias("slot"), name.alias("atom_name"),
        alt.alias("alt_loc"), (F.col("x") + dx).alias("ax"),
    )
    blank = F.lit(" ")
    lacks = F.pmod(sid + pos, F.lit(17)) == 0
    no_atom = F.array().cast("array<struct<record:string,slot:int,atom_name:string,alt_loc:string,ax:double>>")
    some = lambda cond, a: F.when(cond, F.array(a)).otherwise(no_atom)
    listed = F.concat(
        F.array(
            atom("ATOM", 0, F.lit(" N"), blank, 1.0),
            atom("ATOM", 1, F.when(lacks, " CB").otherwise(" CA"), F.when(pos == 7, "A").otherwise(" "), 0.0),
        ),
        some(pos == 7, atom("ATOM", 2, F.lit(" CA"), F.lit("B"), 2.0)),
        some(pos == 10, atom("HETATM", 3, F.lit(" O"), blank, 3.0)),
        some((pos == 0) & (F.pmod(sid, F.lit(40)) == 1), atom("ATOM", 400, F.lit(" OXT"), blank, 4.0)),
    )
    rows = base.withColumn("at", F.explode(listed))
    return rows.select(
        "structure_id", (4 + 4 * pos + F.col("at.slot")).alias("line_no"), "at.record",
        (4 * pos + F.col("at.slot") + 1).alias("serial"), "at.atom_name", "at.alt_loc", "res_name",
        "chain_id", "seq_num", "insert_code", F.col("at.ax").alias("x"), "y", "z",
        F.lit(1.0).alias("occupancy"), F.lit(0.0).alias("temp_factor"),
    )


def interval_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three interval records per structure, with residue ids: HELIX 2-7, SHEET 13-17, TURN 8-10."""
    kinds = (("HELIX", 2, 7), ("SHEET", 13, 17), ("TURN", 8, 10))
    spans = F.explode(F.array(*[
        F.struct(F.lit(k).alias("line_no"), F.lit(kind).alias("kind"), F.lit(p).alias("p"), F.lit(q).alias("q"))
        for k, (kind, p, q) in enumerate(kinds, 1)
    ]))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("structure_id"), spans.alias("s"))
    out = rows.select("structure_id", "s.*")
    for end, at in (("first", "p"), ("last", "q")):
        pos = F.col(at)
        out = out.withColumns({
            f"{end}_chain_id": F.when(pos < 12, "A").otherwise("B"),
            f"{end}_seq_num": F.when(pos < 4, pos + 1).when(pos < 12, pos).otherwise(pos - 11),
            f"{end}_insert_code": F.when(pos == 4, "A").otherwise(" "),
        })
    return out.drop("p", "q")


def structure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure text: interval records, atom records, and two MODEL records in every 50th structure."""
    from strandfold.sources.structures import render_atoms

    spans = interval_ids(spark, sf_dir)
    first = [F.col(f"first_{c}") for c in ("chain_id", "seq_num", "insert_code")]
    last = [F.col(f"last_{c}") for c in ("chain_id", "seq_num", "insert_code")]
    layout = {
        "HELIX": "HELIX    1   1 XXX %s %4d%s XXX %s %4d%s",
        "SHEET": "SHEET    1   A 1 XXX %s%4d%s XXX %s%4d%s",
        "TURN": "TURN     1   1 XXX %s%4d%s XXX %s%4d%s",
    }
    text = F.lit(None).cast("string")
    for kind, form in layout.items():
        text = F.when(F.col("kind") == kind, F.format_string(form, *first, *last)).otherwise(text)
    span_lines = spans.select("structure_id", "line_no", text.alias("line"))
    models = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 50 == 0).select(
        F.col("vec_id").alias("structure_id"), F.explode(F.array(F.lit(1000), F.lit(1001))).alias("line_no"),
    ).withColumn("line", F.lit("MODEL        1"))
    atoms = render_atoms(atom_rows(spark, sf_dir))
    return span_lines.unionByName(atoms).unionByName(models)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of every structure, row-local: (structure_id, sequence)."""
    letters = F.lit(LETTERS * 2)
    n = F.col("n")
    start = F.pmod("structure_id", F.lit(20)).cast("int")
    # a chain longer than the alphabet repeats it
    text = F.repeat(letters, F.ceil(n / 20).cast("int") + 1)
    return chains(spark, sf_dir).select(
        "structure_id", F.substring(text, start + 1, n).alias("sequence")
    )


def packed_alignments(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """given_matches packed per pair, with both sequences: (pair_id, matches, seq_a, seq_b)."""
    grouped = given_matches(spark, sf_dir, side).groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "j"))).alias("matches")
    )
    seq = sequences(spark, sf_dir)
    out = grouped.join(pairs(spark, sf_dir), "pair_id")
    for s in "ab":
        out = out.join(seq.select(F.col("structure_id").alias(s), F.col("sequence").alias(f"seq_{s}")), s)
    return out.select("pair_id", "a", "b", "matches", "seq_a", "seq_b")


def axis_orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four given transforms per pair: turns by 0, 90, 180, 270 degrees about z, shifted by (k, 0, 0)."""
    turns = ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0))
    rows = F.array(*[
        F.struct(
            F.lit(k).cast("long").alias("o_id"),
            F.array(*[F.lit(v) for v in (c, -s, 0.0, float(k), s, c, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)]).alias("m"),
        )
        for k, (c, s) in enumerate(turns)
    ])
    return pairs(spark, sf_dir).select("pair_id", F.explode(rows).alias("o")).select("pair_id", "o.*")


def shift_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of 4-residue fragments as a candidate that only shifts b: centroid onto centroid.

    (pair_id, n = 4, o_id, ssd, m, matches); derived without a shuffle after the chains are attached.
    """
    from strandfold.functions import geometry as G
    from strandfold.operators.chains import attach_chains
    from strandfold.operators.orient import fragment_moments, fragment_starts

    paired = attach_chains(pairs(spark, sf_dir), chains(spark, sf_dir))
    sums = fragment_moments(fragment_starts(paired, 4), 4)
    shift = [(F.col(f"sa{r}") - F.col(f"sb{r}")) / 4 for r in "xyz"]
    cross = F.col("cxx") + F.col("cyy") + F.col("czz")
    raw = F.col("saa") + F.col("sbb") - 2 * cross
    ssd = F.greatest(raw - 4 * G.total([t * t for t in shift]), F.lit(0.0))
    m = F.array(*[
        v for r in range(3) for v in (*[F.lit(1.0 if c == r else 0.0) for c in range(3)], shift[r])
    ])
    steps = F.sequence(F.lit(0), F.lit(3))
    return sums.select(
        "pair_id", F.lit(4).alias("n"), (F.col("i0").cast("long") * 1000 + F.col("j0")).alias("o_id"),
        ssd.alias("ssd"), m.alias("m"),
        F.transform(steps, lambda t: F.struct((F.col("i0") + t).alias("i"), (F.col("j0") + t).alias("j"))).alias("matches"),
    )


def line_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a large candidate table: (pair_id, n, o_id, ssd)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("pair_id"), F.col("l_linenumber").cast("int").alias("n"),
        F.col("l_orderkey").alias("o_id"), F.col("l_extendedprice").alias("ssd"),
    )

"""Hand-checked results: set metrics, displacements, selections, equivalence reports."""

import math

import pytest
from helpers import lines_table, match_table, pair_table

from strandfold.operators import chains as C
from strandfold.operators import compare as CMP
from strandfold.operators import select as SEL
from strandfold.operators import superpose as S
from strandfold.sources import equivalences as EQ
from strandfold.sources import msf as M
from strandfold.sources import structures as ST
from pyspark.sql import functions as F

FIRST = "a note\n..\n\nName: one\n//\n\nA  ABCDEFG\nB  .....AB\n\nA  HI.....\nB  CDEFGHI\n"
SECOND = "a note\n..\n\nName: one\n//\n\nA  ABCDEFG\nB  ....AB.\n\nA  HI.....\nB  CDEFGHI\n"


def matches_of(spark, text):
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    return M.msf_to_matches(M.read_aligned(docs, F.array(F.lit("A"), F.lit("B"))))


def test_set_metrics(spark):
    left, right = matches_of(spark, FIRST), matches_of(spark, SECOND)
    row = CMP.compare_alignments(left, right, ["doc_id"]).first()
    assert (row.e_both, row.e_either) == (2, 6)
    assert (row.ra_both, row.rb_both) == (3, 4)
    assert (row.ra_either, row.rb_either) == (5, 4)
    assert row.e_ratio == pytest.approx(2 / 6)


Z = [(2, 0, 0), (1, 0, 0), (0, 0, 0), (1, 1, 0), (2, 2, 0), (1, 2, 0), (0, 2, 0)]
DIAGONAL = [(0, 0, 0), (0, 1, 1), (0, 2, 2)]


def test_displacement_between_superpositions(spark):
    chains = spark.createDataFrame(
        [(k, len(c), *[[float(p[x]) for p in c] for x in range(3)]) for k, c in ((0, Z), (1, DIAGONAL))],
        "structure_id long, n int, xs array<double>, ys array<double>, zs array<double>")
    paired = C.attach_chains(pair_table(spark, [(0, 1)]), chains)
    sets = {"z": [(2, 0), (3, 1), (4, 2)], "x": [(0, 0), (6, 2)]}
    m = {k: match_table(spark, {0: v}) for k, v in sets.items()}
    fits = {k: S.superpose(S.matched_points(v, paired), ["pair_id"], transform=True) for k, v in m.items()}
    points = C.unpacked(chains).filter("structure_id = 1").select(F.lit(0).cast("long").alias("pair_id"), "pos", "x", "y", "z")
    measure = lambda p: CMP.spatial_displacement(fits["z"], fits["x"], p, ["pair_id"]).first().d3
    assert fits["z"].first().rmsd == pytest.approx(0.0, abs=1e-6)
    assert measure(points) == pytest.approx(math.sqrt(8 / 3), abs=1e-6)
    for which, expected in (("both", 2.0), ("either", math.sqrt(8 / 3))):
        kept = CMP.matched_b(m["z"], m["x"], ["pair_id"], which)
        assert measure(points.join(kept, ["pair_id", "pos"], "left_semi")) == pytest.approx(expected, abs=1e-6)


def atom(serial, name, res, chain, number, x, code=" ", record="ATOM", alt=" "):
    return f"{record:<6}{serial:5d} {name:<4}{alt}{res:<4}{chain}{number:4d}{code}   {x:8.3f}{0.0:8.3f}{0.0:8.3f}{1.0:6.2f}{0.0:6.2f}"


TWO_CHAINS = "\n".join(
    [atom(k, " CA", "ALA", "A", k, float(k)) for k in range(1, 8)] + ["TER"]
    + [atom(20 + k, " CA", "GLY", "B", k, 20.0 + k) for k in range(2, 8)])


def test_selection_of_two_chains(spark):
    res = C.residues(ST.parse_atoms(lines_table(spark, {"d": TWO_CHAINS})))
    pick = lambda spec, **kw: [
        (r.chain_id, r.seq_num) for r in SEL.select_residues(res, spec, **kw).orderBy("pos").collect()]
    assert pick("3-5.A") == [("A", 3), ("A", 4), ("A", 5)]
    assert pick("*.B") == [("B", k) for k in range(2, 8)]
    assert pick("6-*.*") == [("A", 6), ("A", 7), ("B", 6), ("B", 7)]
    assert pick("*-2.A-B") == [("A", 1), ("A", 2), ("B", 2)]
    assert pick("1.A,7.B") == [("A", 1), ("B", 7)]
    assert len(pick("")) == 13
    # chain B lacks residue 1
    assert pick("1", strict=False) == [("A", 1)]
    with pytest.raises(Exception, match="not found"):
        pick("1")
    with pytest.raises(ValueError):
        SEL.parse_selection("1-2-3.A")


def test_insert_codes(spark):
    text = "\n".join(atom(k, " CA", "ALA", "Z", no, float(k), code) for k, (no, code) in enumerate(
        [(26, " "), (27, " "), (27, "A"), (27, "B"), (28, " ")], 1))
    res = C.residues(ST.parse_atoms(lines_table(spark, {"i": text})))
    pick = lambda spec: [(r.seq_num, r.insert_code) for r in SEL.select_residues(res, spec).orderBy("pos").collect()]
    assert pick("27") == [(27, " "), (27, "A"), (27, "B")]
    assert pick("27A-27B") == [(27, "A"), (27, "B")]
    assert pick("26-27A") == [(26, " "), (27, " "), (27, "A")]


def test_equivalence_report_with_insert_codes(spark):
    ids = [(27, "A"), (27, "B"), (27, "C"), (31, " "), (32, " ")]
    text = "\n".join(atom(k, " CA", "ALA", "Z", no, float(k), code) for k, (no, code) in enumerate(ids, 1))
    res = C.residues(ST.parse_atoms(lines_table(spark, {"p": text, "q": text})))
    report = (
        "mail\n## EQUIVALENCES: ranges\n  NR. STRID1 STRID2 STRID1 <=> STRID2\n"
        "   1: p-Z q-Z  1 - 4 <=> 2 - 5   (ALA Z 27A - ALA Z  31 <=> ALA Z 27B - ALA Z  32)  \n"
        "   2: p-Z r-Z  1 - 4 <=> 2 - 5   (ALA Z 27A - ALA Z  31 <=> ALA Z 27B - ALA Z  32)  \n"
        "\n## MATRICES\n")
    docs = spark.createDataFrame([("d", report)], "doc_id string, text string")
    owners = spark.createDataFrame([("d", "p", "q")], "doc_id string, a string, b string")
    ranges = EQ.fssp_ranges(docs, F.lit("p-Z"), F.lit("q-Z"))
    got = [(r.i, r.j) for r in EQ.fssp_to_matches(ranges, res, owners).orderBy("k").collect()]
    assert got == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_first_alternate_wins_and_missing_atoms_drop(spark):
    text = "\n".join([
        atom(1, " CA", "ALA", "A", 1, 1.0, alt="A"), atom(2, " CA", "ALA", "A", 1, 9.0, alt="B"),
        atom(3, " N", "GLY", "A", 2, 2.0), atom(4, " CA", "SER", "A", 3, 3.0),
        atom(5, " CA", "HOH", "A", 9, 3.0, record="HETATM")])
    lines = lines_table(spark, {"s": text})
    atoms = ST.parse_atoms(lines)
    res = C.residues(atoms)
    assert [r.seq_num for r in res.orderBy("pos").collect()] == [1, 2, 3]
    kept = C.require_atoms(res, atoms, [" CA"])
    assert [(r.pos, r.seq_num) for r in kept.orderBy("pos").collect()] == [(0, 1), (1, 3)]
    assert [p.x for p in C.backbone_points(kept, atoms).orderBy("pos").collect()] == [1.0, 3.0]
    assert ST.structure_issues(lines, atoms).first().issue == "alternate atoms"


def test_selected_structure_keeps_whole_intervals_only(spark):
    helix = "HELIX    1   1 ALA A    2  ALA A    4"
    across = "HELIX    2   2 ALA A    6  GLY B    2"
    lines = lines_table(spark, {"d": "\n".join(["REMARK x", helix, across, TWO_CHAINS])})
    res = C.residues(ST.parse_atoms(lines))
    chosen = SEL.clip(res, SEL.selection_intervals(res, "*.A"))
    kept = SEL.select_structure(lines, chosen)
    assert kept.filter("line like 'ATOM%'").count() == 7
    assert [r.line for r in kept.filter("line like 'HELIX%'").collect()] == [helix]
    assert kept.filter("line like 'REMARK%' or line like 'TER%'").count() == 2


def test_compressed_rows(spark):
    df = spark.createDataFrame(
        [([(1, 2)], "GASC", "PMDVT")], "matches array<struct<i:int,j:int>>, seq_a string, seq_b string")
    row = M.matches_to_aligned(df).first()
    assert (row.row_a, row.row_b) == ("G..ASC..", ".PMD..VT")
    row = M.matches_to_aligned(df, compress=True).first()
    assert (row.row_a, row.row_b) == ("g.Asc", "pMDvt")

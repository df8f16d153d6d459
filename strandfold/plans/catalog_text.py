"""Queries over structure and alignment texts, selections and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandfold.functions import codes
from strandfold.operators import chains as C
from strandfold.operators import select as SEL
from strandfold.plans import bridge
from strandfold.plans import oracle as Q
from strandfold.plans.registry import register
from strandfold.sources import equivalences as EQ
from strandfold.sources import msf as M
from strandfold.sources import sinks
from strandfold.sources import structures as ST

num = Q.num
_XYZ = f"{num('x', 'x', 3)}, {num('y', 'y', 3)}, {num('z', 'z', 3)}"


def atoms(spark, sf):
    return ST.parse_atoms(bridge.structure_lines(spark, sf))


@register("parse_atoms", Q.query(
    "SELECT sid AS structure_id, line_no, rec AS record, serial, nm AS atom_name, alt AS alt_loc, rn AS res_name, ch AS chain_id, "
    f"sq AS seq_num, ic AS insert_code, {_XYZ}, 1.0::DOUBLE AS occupancy, 0.0::DOUBLE AS temp_factor FROM atm", Q.ATOMS))
def parse_atoms(spark, sf):
    """Atom records of every structure text as typed rows."""
    return atoms(spark, sf)


@register("render_atoms", Q.query(
    "SELECT sid AS structure_id, line_no, printf('%-6s%5d %-4s%s%-4s%s%4d%s   %8.3f%8.3f%8.3f%6.2f%6.2f', "
    "rec, serial, nm, alt, rn, ch, sq, ic, x, y, z, 1.0, 0.0) AS line FROM atm", Q.ATOMS))
def render_atoms(spark, sf):
    """Parsed atom rows written back as the same fixed-width lines."""
    return ST.render_atoms(atoms(spark, sf))


_SPANS = """
span AS (SELECT r.sid, k.ln, k.kind, r.ch, r.sq, r.ic, t.ch AS ch2, t.sq AS sq2, t.ic AS ic2
  FROM (VALUES (1, 'HELIX', 2, 7), (2, 'SHEET', 13, 17), (3, 'TURN', 8, 10)) k(ln, kind, f, l)
  JOIN res r ON r.p = k.f JOIN res t ON t.sid = r.sid AND t.p = k.l)"""


@register("parse_sse", Q.query(
    "SELECT sid AS structure_id, ln AS line_no, kind, ch AS first_chain_id, sq AS first_seq_num, ic AS first_insert_code, "
    "ch2 AS last_chain_id, sq2 AS last_seq_num, ic2 AS last_insert_code, TRUE AS valid FROM span", _SPANS))
def parse_sse(spark, sf):
    return ST.parse_sse(bridge.structure_lines(spark, sf))


@register("structure_issues", Q.query(
    "SELECT sid AS structure_id, 'several models' AS issue, 2 AS detail_count FROM src WHERE sid % 50 = 0 "
    "UNION ALL SELECT sid, 'residue id in disjoint places', 1 FROM src WHERE sid % 40 = 1 "
    "UNION ALL SELECT sid, 'alternate atoms', 2 FROM src"))
def structure_issues(spark, sf):
    lines = bridge.structure_lines(spark, sf)
    return ST.structure_issues(lines, ST.parse_atoms(lines))


@register("residues", Q.query(
    "SELECT sid AS structure_id, p AS pos, ch AS chain_id, sq AS seq_num, ic AS insert_code, rn AS res_name FROM res"))
def residues(spark, sf):
    return C.residues(atoms(spark, sf))


_CA = "ca AS (SELECT sid, p, arg_min(x, line_no) AS x, arg_min(y, line_no) AS y, arg_min(z, line_no) AS z FROM atm WHERE rec = 'ATOM' AND nm = ' CA' GROUP BY sid, p)"


@register("backbone_points", Q.query(
    f"SELECT sid AS structure_id, p AS pos, 0 AS q, {_XYZ} FROM ca", Q.ATOMS, _CA))
def backbone_points(spark, sf):
    """The CA of every residue; of alternates the first in the file."""
    rows = atoms(spark, sf)
    return C.backbone_points(C.residues(rows), rows)


@register("backbone_two_atoms", Q.query(
    f"SELECT sid AS structure_id, p AS pos, 0 AS q, {_XYZ} FROM ca UNION ALL "
    f"SELECT sid, p, 1, {_XYZ} FROM atm WHERE nm = ' N'", Q.ATOMS, _CA))
def backbone_two_atoms(spark, sf):
    rows = atoms(spark, sf)
    return C.backbone_points(C.residues(rows), rows, [" CA", " N"])


@register("require_atoms", Q.query(
    "SELECT sid AS structure_id, row_number() OVER (PARTITION BY sid ORDER BY p) - 1 AS pos, ch AS chain_id, sq AS seq_num, "
    "ic AS insert_code, rn AS res_name FROM res WHERE (sid + p) % 17 <> 0 OR p = 7"))
def require_atoms(spark, sf):
    """Residues with both N and CA, renumbered."""
    rows = atoms(spark, sf)
    return C.require_atoms(C.residues(rows), rows, [" CA", " N"])


@register("sequences", Q.query(
    "SELECT sid AS structure_id, string_agg(letter, '' ORDER BY p) AS sequence FROM res GROUP BY sid"))
def sequences(spark, sf):
    return C.sequences(C.residues(atoms(spark, sf)), codes.letter_of(F.col("res_name")))


@register("sequences_custom_codes", Q.query(
    "SELECT sid AS structure_id, string_agg(CASE WHEN rn IN ('GLY', 'ALA', 'TRP') THEN letter ELSE '?' END, '' ORDER BY p) AS sequence FROM res GROUP BY sid"))
def sequences_custom_codes(spark, sf):
    few = {"GLY": "G", "ALA": "A", "TRP": "W"}
    return C.sequences(bridge.residues(spark, sf), codes.letter_of(F.col("res_name"), few, "?"))


@register("unknown_residues", Q.query(
    "SELECT sid AS structure_id, p AS pos, rn AS res_name FROM res WHERE rn NOT IN ('GLY', 'ALA', 'TRP')"))
def unknown_residues(spark, sf):
    few = {"GLY": "G", "ALA": "A", "TRP": "W"}
    return codes.unknown_residues(bridge.residues(spark, sf), few).select("structure_id", "pos", "res_name")


@register("select_residues", Q.query(
    "SELECT sid AS structure_id, row_number() OVER (PARTITION BY sid ORDER BY p) - 1 AS pos, ch AS chain_id, sq AS seq_num, "
    "ic AS insert_code, rn AS res_name FROM res WHERE p BETWEEN 4 AND 8 OR p BETWEEN 13 AND 14 OR p BETWEEN 1 AND 4"))
def select_residues(spark, sf):
    """Selection by ranges, an insert code and chains: 4A-8.A, 2-3.B, 2-4.A."""
    return SEL.select_residues(bridge.residues(spark, sf), "4A-8.A,2-3.B,2-4.A")


# Seven texts that structures take in turn, and what they stand for: positions 0-11 are chain A (4 has code A of
# number 4), 12-20 chain B.
_TEXTS = ["2-5.A", "*.B", "3-4A.A, 7-*.B", "", "99.A", "5.Q", "6-8.A-B,x?y"]


def selection_texts(spark, sf):
    texts = F.array(*[F.lit(t) for t in _TEXTS])
    ids = bridge.chains(spark, sf).select("structure_id")
    return ids.withColumn("spec", F.element_at(texts, (F.pmod("structure_id", F.lit(7)) + 1).cast("int")))


@register("selection_outcome", Q.query("""
SELECT sid AS structure_id, term, first_pos, last_pos, error FROM src JOIN bounds ON kind = sid % 7""", """
ends AS (SELECT sid AS id0, min(p) FILTER (ch = 'A') AS a0, max(p) FILTER (ch = 'A') AS a1, min(p) FILTER (ch = 'B') AS b0,
  max(p) FILTER (ch = 'B') AS b1, min(p) FILTER (ch = 'A' AND sq = 2) AS two, max(p) FILTER (ch = 'A' AND sq = 5) AS five,
  min(p) FILTER (ch = 'A' AND sq = 3) AS three, min(p) FILTER (ch = 'A' AND sq = 4 AND ic = 'A') AS four,
  min(p) FILTER (ch = 'B' AND sq = 7) AS seven, min(p) FILTER (ch = 'A' AND sq = 6) AS a6, max(p) FILTER (ch = 'A' AND sq = 8) AS a8,
  min(p) FILTER (ch = 'B' AND sq = 6) AS b6, max(p) FILTER (ch = 'B' AND sq = 8) AS b8 FROM res GROUP BY sid),
one AS (SELECT * FROM ends LIMIT 1),
bounds AS (SELECT 0 AS kind, 0 AS term, two AS first_pos, five AS last_pos, NULL AS error FROM one
  UNION ALL SELECT 1, 0, b0, b1, NULL FROM one
  UNION ALL SELECT 2, 0, three, four, NULL FROM one UNION ALL SELECT 2, 1, seven, b1, NULL FROM one
  UNION ALL SELECT 3, 0, a0, a1, NULL FROM one UNION ALL SELECT 3, 0, b0, b1, NULL FROM one
  UNION ALL SELECT 4, 0, NULL, NULL, 'residue' UNION ALL SELECT 5, 0, NULL, NULL, 'chain'
  UNION ALL SELECT 6, 0, a6, a8, NULL FROM one UNION ALL SELECT 6, 0, b6, b8, NULL FROM one
  UNION ALL SELECT 6, 1, NULL, NULL, 'term')"""))
def selection_outcome(spark, sf):
    """Intervals or errors of a different selection text for every structure."""
    return SEL.selection_outcome(bridge.residues(spark, sf), selection_texts(spark, sf))


@register("select_by_text", Q.query("""
SELECT sid AS structure_id, row_number() OVER (PARTITION BY sid ORDER BY p) - 1 AS pos, ch AS chain_id, sq AS seq_num, ic AS insert_code
FROM res WHERE CASE sid % 7 WHEN 0 THEN ch = 'A' AND sq BETWEEN 2 AND 5 WHEN 1 THEN ch = 'B'
  WHEN 2 THEN (ch = 'A' AND sq BETWEEN 3 AND 4) OR (ch = 'B' AND sq >= 7) WHEN 3 THEN TRUE ELSE FALSE END"""))
def select_by_text(spark, sf):
    """Residues that each structure's own text selects; those whose text has an error have none."""
    out = SEL.select_by_text(bridge.residues(spark, sf), selection_texts(spark, sf))
    return out.select("structure_id", "pos", "chain_id", "seq_num", "insert_code")


@register("selection_intervals", Q.query(
    "SELECT sid AS structure_id, term, f AS first_pos, l AS last_pos FROM src, (VALUES (0, 2, 11), (0, 14, 20), (1, 0, 4), (1, 12, 15), "
    "(2, 12, 20), (3, 5, 5), (3, 16, 16)) t(term, f, l)"))
def selection_intervals(spark, sf):
    """Intervals of open, bounded and single-residue terms over one or both chains."""
    return SEL.selection_intervals(bridge.residues(spark, sf), "3-*.*,*-4,.B,5.A-B")


@register("clip", Q.query(
    "SELECT r.sid AS structure_id, r.p AS pos FROM res r WHERE r.p BETWEEN 2 AND 7 OR r.p BETWEEN 13 AND 17"))
def clip(spark, sf):
    return SEL.clip(bridge.residues(spark, sf), bridge.sse(spark, sf)).select("structure_id", "pos")


@register("invalid_intervals", Q.query(
    "SELECT sid AS structure_id, kind FROM span s WHERE NOT EXISTS (SELECT 1 FROM res r WHERE r.sid = s.sid AND r.ch = s.ch2 AND r.sq = s.sq2 + CASE WHEN s.sid % 2 = 0 THEN 7 ELSE 0 END AND r.ic = s.ic2)",
    _SPANS))
def invalid_intervals(spark, sf):
    """Intervals whose last number is moved past the chain in every second structure."""
    moved = bridge.interval_ids(spark, sf).withColumn("last_seq_num", F.col("last_seq_num") + F.when(
        F.col("structure_id") % 2 == 0, 7).otherwise(0))
    return SEL.invalid_intervals(moved, bridge.residues(spark, sf)).select("structure_id", "kind")


@register("sse_intervals", Q.query(
    "SELECT sid AS structure_id, kind, f - pad AS first_pos, l + pad AS last_pos, pad > 0 AS extended FROM ("
    "SELECT sid, k.kind, k.f, k.l, CAST(ceil((7 - (k.l - k.f + 1)) / 2.0) AS BIGINT) AS pad "
    "FROM src, (VALUES ('HELIX', 2, 7), ('SHEET', 13, 17)) k(kind, f, l))"))
def sse_intervals(spark, sf):
    """Helix and strand intervals found in the residues and widened to at least 7 residues."""
    return SEL.sse_intervals(bridge.interval_ids(spark, sf), bridge.residues(spark, sf), 7)


@register("select_structure", Q.query(
    "SELECT sid AS structure_id, line_no FROM atm WHERE ch = 'A' "
    "UNION ALL SELECT sid, ln FROM (VALUES (1), (3)) t(ln), src "
    "UNION ALL SELECT sid, ln FROM src, (VALUES (1000), (1001)) t(ln) WHERE sid % 50 = 0", Q.ATOMS))
def select_structure(spark, sf):
    """Structure texts cut to chain A: atoms and intervals inside it, and all other lines."""
    lines = bridge.structure_lines(spark, sf)
    chosen = SEL.clip(bridge.residues(spark, sf), SEL.selection_intervals(bridge.residues(spark, sf), "*.A"))
    return SEL.select_structure(lines, chosen).select("structure_id", "line_no")


@register("rotate_structure", Q.query(
    f"SELECT sid AS structure_id, line_no, {num('2.5 - y', 'x', 3)}, {num('x', 'y', 3)}, {num('z - 1', 'z', 3)} FROM atm", Q.ATOMS))
def rotate_structure(spark, sf):
    """All atoms of every structure text turned by 90 degrees about z and shifted."""
    m = F.array(*[F.lit(v) for v in (0.0, -1.0, 0.0, 2.5, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, -1.0)])
    ids = bridge.chains(spark, sf).select("structure_id", m.alias("m"))
    moved = ST.rotate_structure(bridge.structure_lines(spark, sf), ids)
    return ST.parse_atoms(moved).select("structure_id", "line_no", "x", "y", "z")


# Aligned strings in SQL: every residue of a and b gets an order key, then rows are concatenated.
def _aligned_sql(compress: bool) -> str:
    mark = "lower" if compress else ""
    over = "least(c.i - c.pi - 1, c.j - c.pj - 1)" if compress else "0"
    return f"""
sg AS (SELECT pid, i, j, coalesce(lag(i) OVER w, -1) AS pi, coalesce(lag(j) OVER w, -1) AS pj, k FROM (
  SELECT pid, k, i, j FROM lft UNION ALL SELECT pid, 1000, na, nb FROM prs) WINDOW w AS (PARTITION BY pid ORDER BY k)),
sq AS (SELECT sid, string_agg(letter, '' ORDER BY p) AS s FROM res GROUP BY sid),
st AS (SELECT c.pid, c.k, {over} AS o, c.i - c.pi - 1 AS ga, c.j - c.pj - 1 AS gb, c.i, c.j, c.pi, c.pj, u.s AS sa, v.s AS sb
  FROM sg c JOIN prs USING (pid) JOIN sq u ON u.sid = prs.a JOIN sq v ON v.sid = prs.b),
rows_ AS (SELECT pid,
  string_agg({mark or 'concat'}(substr(sa, pi + 2, o)) || substr(sa, pi + 2 + o, ga - o) || repeat('.', gb - o) || substr(sa, i + 1, 1), '' ORDER BY k) AS row_a,
  string_agg({mark or 'concat'}(substr(sb, pj + 2, o)) || repeat('.', ga - o) || substr(sb, pj + 2 + o, gb - o) || substr(sb, j + 1, 1), '' ORDER BY k) AS row_b
  FROM st GROUP BY pid)"""


@register("matches_to_aligned", Q.query("SELECT pid AS pair_id, row_a, row_b FROM rows_", _aligned_sql(False)))
def matches_to_aligned(spark, sf):
    """Matches as two gapped strings."""
    rows = M.matches_to_aligned(bridge.packed_alignments(spark, sf, "left"))
    return rows.select("pair_id", "row_a", "row_b")


@register("matches_to_aligned_compressed", Q.query("SELECT pid AS pair_id, row_a, row_b FROM rows_", _aligned_sql(True)))
def matches_to_aligned_compressed(spark, sf):
    rows = M.matches_to_aligned(bridge.packed_alignments(spark, sf, "left"), compress=True)
    return rows.select("pair_id", "row_a", "row_b")


def docs(spark, sf, compress=False):
    """Alignment documents written from the given matches, labels A and B."""
    rows = M.matches_to_aligned(bridge.packed_alignments(spark, sf, "left"), compress)
    text = M.msf_text(F.lit("written for a check"), F.lit("chainA"), F.lit("B"))
    return rows.select(F.col("pair_id").alias("doc_id"), text.alias("text"))


def labels():
    return F.array(F.lit("chainA"), F.lit("B"))


@register("read_aligned", Q.query(
    "SELECT pid AS doc_id, 0 AS side, 'chainA' AS label, row_a AS seq FROM rows_ UNION ALL SELECT pid, 1, 'B', row_b FROM rows_", _aligned_sql(False)))
def read_aligned(spark, sf):
    """Alignment documents written and read back."""
    return M.read_aligned(docs(spark, sf), labels())


@register("msf_sequence", Q.query(
    "SELECT r.pid AS doc_id, 'B' AS label, s.s AS sequence FROM prs r JOIN (SELECT sid, string_agg(letter, '' ORDER BY p) AS s FROM res GROUP BY sid) s ON s.sid = r.b"))
def msf_sequence(spark, sf):
    return M.msf_sequence(docs(spark, sf), F.lit("B"))


@register("msf_to_matches", Q.query("SELECT pid AS doc_id, k, i, j FROM lft"))
def msf_to_matches(spark, sf):
    """The matches behind written documents."""
    return M.msf_to_matches(M.read_aligned(docs(spark, sf), labels()))


@register("msf_compressed_to_matches", Q.query("SELECT pid AS doc_id, k, i, j FROM lft"))
def msf_compressed_to_matches(spark, sf):
    return M.msf_to_matches(M.read_aligned(docs(spark, sf, True), labels()), lower_is_unmatched=True)


@register("msf_mismatches", Q.query(
    "SELECT pid AS doc_id, 0 AS side, 5 AS pos, letter AS found, '-' AS expected FROM prs JOIN res ON res.sid = prs.a AND p = 5 WHERE pid % 5 = 1 "
    "UNION ALL SELECT pid, 1, NULL, nb::VARCHAR, (nb - 1)::VARCHAR FROM prs WHERE pid % 5 = 2"))
def msf_mismatches(spark, sf):
    """Documents against sequences that are altered in some pairs."""
    packed = bridge.packed_alignments(spark, sf, "left")
    which = F.col("pair_id") % 5
    a = F.when(which == 1, F.concat(F.substring("seq_a", 1, 5), F.lit("-"), F.expr("substr(seq_a, 7)"))).otherwise(F.col("seq_a"))
    b = F.when(which == 2, F.expr("substr(seq_b, 2)")).otherwise(F.col("seq_b"))
    wanted = packed.select(F.col("pair_id").alias("doc_id"), F.explode(F.array(
        F.struct(F.lit(0).alias("side"), a.alias("sequence")), F.struct(F.lit(1).alias("side"), b.alias("sequence")),
    )).alias("r")).select("doc_id", "r.*")
    return M.msf_mismatches(M.read_aligned(docs(spark, sf), labels()), wanted)



@register("fssp_to_matches", Q.query(
    "SELECT pid AS doc_id, row_number() OVER (PARTITION BY pid ORDER BY i) - 1 AS k, i, i + 1 AS j FROM ("
    "SELECT pid, unnest(range(2, 8)) AS i FROM prs UNION ALL SELECT pid, unnest(range(12, 18)) FROM prs)"))
def fssp_to_matches(spark, sf):
    """Reports with two equivalent ranges per pair (one with an insert code), labels in reverse order in every second."""
    res = bridge.residues(spark, sf)
    owners = bridge.pairs(spark, sf).withColumnRenamed("pair_id", "doc_id")
    text_of = lambda r: F.concat(
        r["res_name"], F.lit(" "), r["chain_id"], F.lit("  "), r["seq_num"].cast("string"), F.rtrim(r["insert_code"]))
    at = res.groupBy("structure_id").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("pos"), F.struct("res_name", "chain_id", "seq_num", "insert_code")))).alias("at"))
    named = owners
    for side in "ab":
        named = named.join(at.select(F.col("structure_id").alias(side), F.col("at").alias(f"at_{side}")), side)
    span = lambda side, f, l: F.concat(text_of(F.col(f"at_{side}")[f]), F.lit(" - "), text_of(F.col(f"at_{side}")[l]))

    def line(no, f, l):
        a, b = span("a", f, l), span("b", f + 1, l + 1)
        head = lambda x, y: F.lit(f"  {no}: {x} {y}     {f} - {l} <=>  {f} - {l}   (")
        turned = F.concat(head("molB", "molA"), b, F.lit(" <=> "), a, F.lit(")   "))
        straight = F.concat(head("molA", "molB"), a, F.lit(" <=> "), b, F.lit(")   "))
        return F.when(F.col("doc_id") % 2 == 0, straight).otherwise(turned)

    text = F.concat_ws(
        "\n", F.lit("some mail header"), F.lit("## EQUIVALENCES: ranges"), F.lit("  NR. STRID1 STRID2   STRID1 <=> STRID2"),
        line(1, 2, 7), line(2, 12, 17), F.lit(""), F.lit("## MATRICES"), line(3, 0, 1))
    reports = named.select("doc_id", text.alias("text"))
    return EQ.fssp_to_matches(EQ.fssp_ranges(reports, F.lit("molA"), F.lit("molB")), res, owners)


def _reports(spark, sf):
    """Server reports with one ten-token row per match; every seventh pair states a wrong name once."""
    res = bridge.residues(spark, sf).select("structure_id", "pos", "res_name", "seq_num")
    rows = bridge.given_matches(spark, sf, "right").join(bridge.pairs(spark, sf), "pair_id")
    for side, index in (("a", "i"), ("b", "j")):
        rows = rows.join(res.select(
            F.col("structure_id").alias(side), F.col("pos").alias(index),
            F.col("res_name").alias(f"{side}_name"), F.col("seq_num").alias(f"{side}_seq")), [side, index])
    name = F.when((F.col("pair_id") % 7 == 0) & (F.col("k") == 2), "XXX").otherwise(F.col("a_name"))
    line = F.concat_ws(" ", F.lit("="), (F.col("i") + 1).cast("string"), name, F.col("a_seq").cast("string"), F.lit("x y 0.5"),
                       (F.col("j") + 1).cast("string"), F.col("b_name"), F.col("b_seq").cast("string"))
    lines = rows.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("l")))).alias("ls"))
    text = F.concat(F.lit("report\nEQUIV 1 2\n"), F.array_join("ls.l", "\n"), F.lit("\nend of list\n"))
    return lines.select(F.col("pair_id").alias("doc_id"), text.alias("text"))


@register("align_report_to_matches", Q.query("SELECT pid AS doc_id, k, i, j FROM rgt"))
def align_report_to_matches(spark, sf):
    return EQ.align_report_to_matches(EQ.align_report_pairs(_reports(spark, sf)))


@register("align_report_mismatches", Q.query(
    "SELECT pid AS doc_id, k AS at, 'a' AS side, 'XXX' AS stated, rn AS found FROM rgt JOIN prs USING (pid) JOIN res ON res.sid = prs.a AND res.p = rgt.i "
    "WHERE pid % 7 = 0 AND k = 2"))
def align_report_mismatches(spark, sf):
    owners = bridge.pairs(spark, sf).withColumnRenamed("pair_id", "doc_id")
    return EQ.align_report_mismatches(EQ.align_report_pairs(_reports(spark, sf)), bridge.residues(spark, sf), owners)


@register("parse_transforms", Q.query(
    f"SELECT pid * 4 + o AS doc_id, {num('c::DOUBLE', 'm11')}, {num('-s::DOUBLE', 'm12')}, {num('o::DOUBLE', 'm14')}, {num('s::DOUBLE', 'm21')}, 1.0::DOUBLE AS m33 FROM axo"))
def parse_transforms(spark, sf):
    """Transform files written from the given orientations and read back."""
    text = bridge.axis_orientations(spark, sf).select(
        (F.col("pair_id") * 4 + F.col("o_id")).alias("doc_id"), sinks.transform_text(F.col("m")).alias("text"))
    m = F.col("m")
    return EQ.parse_transforms(text).select(
        "doc_id", m[0].alias("m11"), m[1].alias("m12"), m[3].alias("m14"), m[4].alias("m21"), m[10].alias("m33"))


@register("render_solutions")
def render_solutions(spark, sf):
    """Best alignments of every pair as placed, as documents."""
    from strandfold.operators.align import Search, layered_align
    from strandfold.plans.catalog_align import identity_blocks

    best = layered_align(identity_blocks(spark, sf), Search(n_min=0.5, refine=True)).withColumn("rank", F.lit(1))
    seq = bridge.packed_alignments(spark, sf, "left").select(
        "pair_id", "seq_a", "seq_b", F.col("a").cast("string").alias("label_a"), F.col("b").cast("string").alias("label_b"))
    return sinks.render_solutions(best, seq)

"""Queries that compare alignments with each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandfold.operators import compare as CMP
from strandfold.operators import select as SEL
from strandfold.operators import superpose as S
from strandfold.plans import bridge
from strandfold.plans import oracle as Q
from strandfold.plans.catalog_geometry import given_points
from strandfold.plans.registry import register

num = Q.num


def both_sides(spark, sf):
    return (bridge.given_matches(spark, sf, side) for side in ("left", "right"))


_OVERLAP = """
j AS (SELECT coalesce(l.{k}, r.{k}) AS k, l.{k} IS NOT NULL AS il, r.{k} IS NOT NULL AS ir
  FROM {l} l FULL JOIN {r} r ON l.{k} = r.{k} AND l.i = r.i AND l.j = r.j),
pc AS (SELECT k, count(*) FILTER (il) AS n_left, count(*) FILTER (ir) AS n_right, count(*) FILTER (il AND ir) AS e_both,
  count(*) AS e_either FROM j GROUP BY k)"""
_PAIR_COLUMNS = (
    f"n_left, n_right, e_both, e_either, {num('e_both / e_either', 'e_ratio')}, {num('e_both / greatest(n_left, n_right)', 'e_share')}"
)
_RESIDUES = """
ra AS (SELECT k, count(*) FILTER (m = 3) AS ra_both, count(*) AS ra_either FROM (
  SELECT k, i, bit_or(s) AS m FROM (SELECT pid AS k, i, 1 AS s FROM lft UNION ALL SELECT pid, i, 2 FROM rgt) GROUP BY k, i) GROUP BY k),
rb AS (SELECT k, count(*) FILTER (m = 3) AS rb_both, count(*) AS rb_either FROM (
  SELECT k, j, bit_or(s) AS m FROM (SELECT pid AS k, j, 1 AS s FROM lft UNION ALL SELECT pid, j, 2 FROM rgt) GROUP BY k, j) GROUP BY k)"""


@register("compare_alignments", Q.query(
    f"SELECT k AS pair_id, {_PAIR_COLUMNS}, ra_both, ra_either, rb_both, rb_either, "
    f"{num('(ra_both + rb_both) / (ra_either + rb_either)', 'r_ratio')}, "
    f"{num('(ra_both + rb_both) / (2 * greatest(n_left, n_right))', 'r_share')}, "
    f"{num('ra_both / ra_either', 'ra_ratio')}, {num('rb_both / rb_either', 'rb_ratio')} "
    "FROM pc JOIN ra USING (k) JOIN rb USING (k)", _OVERLAP.format(k="pid", l="lft", r="rgt"), _RESIDUES))
def compare_alignments(spark, sf):
    return CMP.compare_alignments(*both_sides(spark, sf), ["pair_id"])


_SETS = "ms AS (SELECT DISTINCT l_linestatus AS st, l_suppkey AS c, l_partkey % 100 AS i, CAST(l_quantity AS BIGINT) AS j FROM lineitem)"
_SIDES = "ls AS (SELECT * FROM ms WHERE st = 'O'), rs AS (SELECT * FROM ms WHERE st = 'F')"


@register("pair_overlap_large", Q.query(
    f"SELECT k AS case_id, {_PAIR_COLUMNS} FROM pc", _SETS, _SIDES, _OVERLAP.format(k="c", l="ls", r="rs")))
def pair_overlap_large(spark, sf):
    """Shared pairs of large unordered match sets, one case per supplier."""
    return CMP.pair_overlap(bridge.match_sets(spark, sf, "O"), bridge.match_sets(spark, sf, "F"), ["case_id"])


@register("common_pairs", Q.query(
    "SELECT l.c AS case_id, l.i, l.j FROM ls l JOIN rs r ON l.c = r.c AND l.i = r.i AND l.j = r.j", _SETS, _SIDES))
def common_pairs(spark, sf):
    return CMP.common_pairs(bridge.match_sets(spark, sf, "O"), bridge.match_sets(spark, sf, "F"), ["case_id"])


_FITS = (
    Q.matched("lft", "mpl"), Q.moments("mpl", "pid", "moml"), Q.fit("pid", "moml", "fitl"), Q.rotation("pid", "fitl", "rotl"),
    Q.matched("rgt", "mpr"), Q.moments("mpr", "pid", "momr"), Q.fit("pid", "momr", "fitr"), Q.rotation("pid", "fitr", "rotr"),
)


def _displacement(points: str) -> str:
    d = " + ".join(
        f"pow((l.m{r}1 - r.m{r}1) * p.x + (l.m{r}2 - r.m{r}2) * p.y + (l.m{r}3 - r.m{r}3) * p.z + l.m{r}4 - r.m{r}4, 2)"
        for r in (1, 2, 3))
    return (
        f"SELECT prs.pid AS pair_id, {num(f'sqrt(avg({d}))', 'd3', 3)} FROM prs JOIN rotl l USING (pid) JOIN rotr r USING (pid) "
        f"JOIN pts p ON p.sid = prs.b {points} GROUP BY prs.pid")


def _fits(spark, sf):
    return [S.superpose(given_points(spark, sf, side), ["pair_id"], transform=True) for side in ("left", "right")]


def _b_points(spark, sf):
    owners = bridge.pairs(spark, sf).select("pair_id", F.col("b").alias("structure_id"))
    return owners.join(bridge.points(spark, sf), "structure_id").select("pair_id", "pos", "x", "y", "z")


def _shown(df):
    return df.select("pair_id", F.round("d3", 3).alias("d3"))


@register("displacement_all", Q.query(_displacement(""), *_FITS))
def displacement_all(spark, sf):
    return _shown(CMP.spatial_displacement(*_fits(spark, sf), _b_points(spark, sf), ["pair_id"]))


@register("displacement_both", Q.query(_displacement(
    "AND EXISTS (SELECT 1 FROM lft m WHERE m.pid = prs.pid AND m.j = p.p) AND EXISTS (SELECT 1 FROM rgt m WHERE m.pid = prs.pid AND m.j = p.p)"), *_FITS))
def displacement_both(spark, sf):
    """Only the residues of b matched in both alignments."""
    kept = CMP.matched_b(*both_sides(spark, sf), ["pair_id"], "both")
    points = _b_points(spark, sf).join(kept, ["pair_id", "pos"], "left_semi")
    return _shown(CMP.spatial_displacement(*_fits(spark, sf), points, ["pair_id"]))


@register("displacement_either", Q.query(_displacement(
    "AND (EXISTS (SELECT 1 FROM lft m WHERE m.pid = prs.pid AND m.j = p.p) OR EXISTS (SELECT 1 FROM rgt m WHERE m.pid = prs.pid AND m.j = p.p))"), *_FITS))
def displacement_either(spark, sf):
    kept = CMP.matched_b(*both_sides(spark, sf), ["pair_id"], "either")
    points = _b_points(spark, sf).join(kept, ["pair_id", "pos"], "left_semi")
    return _shown(CMP.spatial_displacement(*_fits(spark, sf), points, ["pair_id"]))


@register("sequence_conflicts", Q.query(
    "SELECT s.sid AS doc_id, s.label, s.seq AS left_seq, t.seq AS right_seq FROM sq s JOIN sq t ON t.sid = s.sid AND s.label <> t.label "
    "WHERE s.seq <> t.seq AND s.sid % 3 = 0",
    "base AS (SELECT sid, string_agg(letter, '' ORDER BY p) AS seq FROM res GROUP BY sid)",
    "sq AS (SELECT sid, 'A' AS label, seq FROM base UNION ALL SELECT sid, 'B', substr(seq, 2) FROM base)"))
def sequence_conflicts(spark, sf):
    """Every third document swaps its two sequences between the alignments compared."""
    seq = bridge.sequences(spark, sf).withColumnRenamed("structure_id", "doc_id")
    rows = seq.select("doc_id", F.explode(F.array(
        F.struct(F.lit("A").alias("label"), F.col("sequence").alias("seq")),
        F.struct(F.lit("B").alias("label"), F.expr("substr(sequence, 2)").alias("seq")),
    )).alias("r")).select("doc_id", "r.*")
    swapped = rows.withColumn("label", F.when(
        F.col("doc_id") % 3 == 0, F.when(F.col("label") == "A", "B").otherwise("A")).otherwise(F.col("label")))
    return CMP.sequence_conflicts(rows, swapped, ["doc_id"])


@register("is_monotonic", Q.query(
    "SELECT pid AS pair_id, bool_and(coalesce(i > pi, TRUE) AND coalesce(j > pj, TRUE)) AS monotonic FROM ("
    "SELECT *, lag(i) OVER w AS pi, lag(j) OVER w AS pj FROM (SELECT pid, k, i, CASE WHEN pid % 4 = 0 THEN (j * 5) % 21 ELSE j END AS j FROM lft) "
    "WINDOW w AS (PARTITION BY pid ORDER BY k)) GROUP BY pid"))
def is_monotonic(spark, sf):
    mixed = bridge.given_matches(spark, sf, "left").withColumn(
        "j", F.when(F.col("pair_id") % 4 == 0, (F.col("j") * 5) % 21).otherwise(F.col("j")))
    return SEL.is_monotonic(mixed, "pair_id")


@register("same_alignment", Q.query(
    "SELECT pid AS pair_id, bool_and(l IS NOT NULL AND r IS NOT NULL) AS same FROM ("
    "SELECT coalesce(l.pid, r.pid) AS pid, l.k AS l, r.k AS r FROM lft l FULL JOIN rgt r ON l.pid = r.pid AND l.k = r.k AND l.i = r.i AND l.j = r.j) GROUP BY pid"))
def same_alignment(spark, sf):
    return SEL.same_alignment(*both_sides(spark, sf), "pair_id")


@register("reindex_matches", Q.query(
    "SELECT l.pid AS pair_id, l.k, u.np AS i, v.np AS j FROM lft l JOIN prs USING (pid) JOIN kept u ON u.sid = prs.a AND u.p = l.i "
    "JOIN kept v ON v.sid = prs.b AND v.p = l.j",
    "kept AS (SELECT sid, p, row_number() OVER (PARTITION BY sid ORDER BY p) - 1 AS np FROM res WHERE ch = 'B' OR sq <= 6)"))
def reindex_matches(spark, sf):
    """Matches carried over to structures cut down by a selection."""
    res = bridge.residues(spark, sf)
    fewer = SEL.select_residues(res, "*-6.A,*.B")
    return SEL.reindex_matches(bridge.given_matches(spark, sf, "left"), bridge.pairs(spark, sf), res, fewer)

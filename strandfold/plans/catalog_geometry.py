"""Queries over chains, points, superpositions and orientations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandfold.functions import geometry as G
from strandfold.operators import chains as C
from strandfold.operators import compare as CMP
from strandfold.operators import histogram as H
from strandfold.operators import orient as O
from strandfold.operators import score as SC
from strandfold.operators import superpose as S
from strandfold.operators.align import match_count
from strandfold.operators.select import extend_intervals, sse_interval_pairs
from strandfold.plans import bridge
from strandfold.plans import oracle as Q
from strandfold.plans.registry import register

num = Q.num


def paired(spark, sf):
    return C.attach_chains(bridge.pairs(spark, sf), bridge.chains(spark, sf))


def given_points(spark, sf, side="left"):
    return S.matched_points(bridge.given_matches(spark, sf, side), paired(spark, sf))


@register("chain_points", Q.query(
    f"SELECT sid AS structure_id, p AS pos, {num('x', 'x')}, {num('y', 'y')}, {num('z', 'z')} FROM pts"))
def chain_points(spark, sf):
    return C.unpacked(bridge.chains(spark, sf)).drop("q")


@register("packed_chains", Q.query(
    "SELECT sid AS structure_id, count(*) AS n, " + num("sum(p * x + y)", "checksum", 3) + " FROM pts GROUP BY sid"))
def packed_chains(spark, sf):
    """Long points packed by an aggregation and read again in order."""
    again = C.packed(bridge.points(spark, sf))
    total = F.aggregate(
        F.zip_with(F.sequence(F.lit(0), F.col("n") - 1), F.arrays_zip("xs", "ys"), lambda p, v: p * v["xs"] + v["ys"]),
        F.lit(0.0), lambda acc, v: acc + v,
    )
    return again.select("structure_id", "n", F.round(total, 3).alias("checksum"))


@register("centroids", Q.query(
    f"SELECT sid AS structure_id, {num('avg(x)', 'cx')}, {num('avg(y)', 'cy')}, {num('avg(z)', 'cz')} FROM pts GROUP BY sid"))
def centroids(spark, sf):
    return C.centroid(bridge.points(spark, sf))


_SCATTER = """
sc AS (SELECT sid, sum(x*x) - sum(x)*sum(x)/count(*) AS a, sum(y*y) - sum(y)*sum(y)/count(*) AS b,
  sum(z*z) - sum(z)*sum(z)/count(*) AS c, sum(x*y) - sum(x)*sum(y)/count(*) AS d,
  sum(x*z) - sum(x)*sum(z)/count(*) AS f, sum(y*z) - sum(y)*sum(z)/count(*) AS h FROM pts GROUP BY sid)"""


@register("scatter_invariants", Q.query(
    f"SELECT sid AS structure_id, {num('a + b + c', 'trace', 3)}, "
    f"{num('a*b - d*d + a*c - f*f + b*c - h*h', 'minors', 2)}, "
    f"{num('a*(b*c - h*h) - d*(d*c - h*f) + f*(d*h - b*f)', 'determinant', 1)} FROM sc", _SCATTER))
def scatter_invariants(spark, sf):
    out = C.scatter_invariants(C.structure_moments(bridge.points(spark, sf)))
    return out.select(
        "structure_id", F.round("trace", 3).alias("trace"), F.round("minors", 2).alias("minors"),
        F.round("determinant", 1).alias("determinant"),
    )


@register("principal_axes", Q.query(
    f"SELECT sid AS structure_id, {num('a + b + c', 'length_sum', 3)}, "
    f"{num('a*a + b*b + c*c + 2*(d*d + f*f + h*h)', 'length_squares', 1)}, 1.0::DOUBLE AS frame_det FROM sc", _SCATTER))
def principal_axes(spark, sf):
    """Axis lengths checked through their power sums; the frame must be orthonormal."""
    axes = C.principal_axes(C.structure_moments(bridge.points(spark, sf)))
    f = F.col("frame")
    det = (
        f[0] * (f[4] * f[8] - f[5] * f[7]) - f[1] * (f[3] * f[8] - f[5] * f[6]) + f[2] * (f[3] * f[7] - f[4] * f[6])
    )
    add = lambda acc, v: acc + v
    return axes.select(
        "structure_id", F.round(F.aggregate("lengths", F.lit(0.0), add), 3).alias("length_sum"),
        F.round(F.aggregate(F.transform("lengths", lambda v: v * v), F.lit(0.0), add), 1).alias("length_squares"),
        F.abs(det).alias("frame_det"),
    )


@register("pair_sizes", Q.query(
    "SELECT pid AS pair_id, a, b, na, nb, least(na, nb) AS n_most FROM prs"))
def pair_sizes(spark, sf):
    return C.pair_sizes(S.structure_pairs(bridge.chains(spark, sf), bridge.pairs(spark, sf)), bridge.chains(spark, sf))


@register("match_counts", Q.query(
    "SELECT pid AS pair_id, 5 AS whole, 1 AS single, least(na, nb) AS every, "
    "CAST(floor(0.33 * least(na, nb) + 0.5) AS BIGINT) AS third FROM prs"))
def match_counts(spark, sf):
    sizes = C.pair_sizes(bridge.pairs(spark, sf), bridge.chains(spark, sf))
    n = F.col("n_most")
    return sizes.select(
        "pair_id", match_count(5, n).alias("whole"), match_count("1", n).alias("single"),
        match_count("1.", n).alias("every"), match_count(0.33, n).alias("third"),
    )


_D2 = "(ax-bx)*(ax-bx) + (ay-by_)*(ay-by_) + (az-bz)*(az-bz)"


@register("pair_distances", Q.query(
    f"SELECT pid AS pair_id, count(*) AS cells, {num(f'sum({_D2})', 'd2_sum', 2)} FROM cells "
    f"WHERE {_D2} <= 36 AND j - i BETWEEN -(na - 7) AND nb - 7 GROUP BY pid"))
def pair_distances(spark, sf):
    """Cells within 6 of each other inside the band of at least 7 matches."""
    return H.pair_distances(paired(spark, sf), 7, 6.0).groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.sum("d2"), 2).alias("d2_sum"))


@register("distance_extent", Q.query(
    f"SELECT pid AS pair_id, {num(f'min({_D2})', 'd2_min')}, {num(f'max({_D2})', 'd2_max')} FROM cells GROUP BY pid"))
def distance_extent(spark, sf):
    return H.distance_extent(paired(spark, sf))


@register("superpose_rmsd", Q.query(
    f"SELECT pid AS pair_id, cnt::BIGINT AS n_atoms, {num('ssd', 'ssd')}, {num('rmsd', 'rmsd')} FROM fit",
    Q.matched("lft", "mp"), Q.moments("mp", "pid"), Q.fit("pid")))
def superpose_rmsd(spark, sf):
    return S.superpose(given_points(spark, sf), ["pair_id"])


@register("superpose_transforms", Q.query(
    "SELECT pid AS pair_id, " + ", ".join(num(f"m{r}{c}", f"m{r}{c}", 3) for r in (1, 2, 3) for c in (1, 2, 3, 4)) + " FROM rot",
    Q.matched("lft", "mp"), Q.moments("mp", "pid"), Q.fit("pid"), Q.rotation("pid")))
def superpose_transforms(spark, sf):
    fits = S.superpose(given_points(spark, sf), ["pair_id"], transform=True)
    return fits.select("pair_id", *[
        F.round(F.col("m")[4 * r + c], 3).alias(f"m{r + 1}{c + 1}") for r in range(3) for c in range(4)])


@register("alignment_rmsd", Q.query(
    f"SELECT pid AS pair_id, {num(f'sum({_D2})', 'ssd')}, {num(f'sqrt(avg({_D2}))', 'rmsd')} FROM mp GROUP BY pid",
    Q.matched("rgt", "mp")))
def alignment_rmsd(spark, sf):
    return S.alignment_rmsd(given_points(spark, sf, "right"), ["pair_id"])


@register("furthest_pair", Q.query(
    f"SELECT pid AS pair_id, {num('sqrt(max(d2))', 'max_dist')}, arg_max(i, d2) AS i, arg_max(j, d2) AS j FROM dd GROUP BY pid",
    Q.matched("lft", "mp"), f"dd AS (SELECT *, {_D2} AS d2 FROM mp)"))
def furthest_pair(spark, sf):
    return S.furthest_pair(given_points(spark, sf), ["pair_id"])


_SCORE_COLUMNS = (
    f"n, gaps::BIGINT AS gaps, {num('s_str', 's_str')}, {num('mu_str', 'mu_str')}, {num('delta_str', 'delta_str')}, "
    f"{num('z_str', 'z_str')}, {num('p_str', 'p_str')}"
)


@register("alignment_score", Q.query(
    f"SELECT pid AS pair_id, {_SCORE_COLUMNS} FROM sco",
    Q.matched("lft", "mp"), f"dd AS (SELECT *, {_D2} AS d2 FROM mp)", Q.scores("dd", "pid")))
def alignment_score(spark, sf):
    return SC.alignment_score(given_points(spark, sf), ["pair_id"])


_MOVED = """
mv AS (SELECT mp.*, m11*bx + m12*by_ + m13*bz + m14 - ax AS dx, m21*bx + m22*by_ + m23*bz + m24 - ay AS dy,
  m31*bx + m32*by_ + m33*bz + m34 - az AS dz FROM mp JOIN rot USING (pid)),
dd AS (SELECT pid, k, i, j, dx*dx + dy*dy + dz*dz AS d2 FROM mv),
agg AS (SELECT pid, sqrt(avg(d2)) AS rmsd, sqrt(max(d2)) AS max_dist FROM dd GROUP BY pid)"""


@register("alignment_stats", Q.query(
    f"SELECT pid AS pair_id, {num('rmsd', 'rmsd')}, {num('max_dist', 'max_dist')}, {_SCORE_COLUMNS} FROM agg JOIN sco USING (pid)",
    Q.matched("lft", "mp"), Q.moments("mp", "pid"), Q.fit("pid"), Q.rotation("pid"), _MOVED, Q.scores("dd", "pid")))
def alignment_stats(spark, sf):
    """One statistics row per pair after the best superposition of the given matches."""
    return SC.alignment_stats(given_points(spark, sf), ["pair_id"]).drop("ssd")


@register("alignment_stats_as_placed", Q.query(
    f"SELECT pid AS pair_id, {num('rmsd', 'rmsd')}, {num('max_dist', 'max_dist')}, {_SCORE_COLUMNS} FROM agg JOIN sco USING (pid)",
    Q.matched("rgt", "mp"), f"dd AS (SELECT *, {_D2} AS d2 FROM mp)",
    "agg AS (SELECT pid, sqrt(avg(d2)) AS rmsd, sqrt(max(d2)) AS max_dist FROM dd GROUP BY pid)", Q.scores("dd", "pid")))
def alignment_stats_as_placed(spark, sf):
    return SC.alignment_stats(given_points(spark, sf, "right"), ["pair_id"], optimize=False).drop("ssd")


@register("solution_profile", Q.query(
    f"SELECT pid AS pair_id, n, {num('rmsd', 'rmsd')}, {num('max_dist', 'max_dist')}, "
    f"{num('CASE WHEN p_str = 0 THEN 0 ELSE -log10(p_str) END', 'strength')}, {num('s_str', 's_str')}, "
    f"{num('mu_str', 'mu_str')}, {num('delta_str', 'delta_str')}, {num('z_str', 'z_str')} FROM agg JOIN sco USING (pid)",
    Q.matched("rgt", "mp"), Q.moments("mp", "pid"), Q.fit("pid"), Q.rotation("pid"), _MOVED, Q.scores("dd", "pid")))
def solution_profile(spark, sf):
    return SC.solution_profile(SC.alignment_stats(given_points(spark, sf, "right"), ["pair_id"]), ["pair_id"])


@register("apply_transform", Q.query(
    f"SELECT pid AS pair_id, o AS o_id, p AS pos, {num('c*x - s*y + o', 'x')}, {num('s*x + c*y', 'y')}, {num('z', 'z')} "
    "FROM axo JOIN prs USING (pid) JOIN pts ON pts.sid = prs.b"))
def apply_transform(spark, sf):
    """All four given transforms of every pair applied to its second chain."""
    owners = bridge.pairs(spark, sf).select("pair_id", F.col("b").alias("structure_id"))
    rows = bridge.axis_orientations(spark, sf).join(owners, "pair_id").join(bridge.points(spark, sf), "structure_id")
    return S.apply_transform(rows).select("pair_id", "o_id", "pos", "x", "y", "z")


_FRAGMENTS = """
frag AS (SELECT s.pid, s.na, s.nb, s.i AS i0, s.j AS j0, c.ax, c.ay, c.az, c.bx, c.by_, c.bz
  FROM cells s JOIN (SELECT unnest(range(4)) AS t) ON TRUE JOIN cells c ON c.pid = s.pid AND c.i = s.i + t AND c.j = s.j + t
  WHERE s.i <= s.na - 4 AND s.j <= s.nb - 4)"""


def fragment_fits(spark, sf):
    return O.fragment_fits(O.fragment_starts(paired(spark, sf), 4), 4)


@register("fragment_rmsd", Q.query(
    f"SELECT pid AS pair_id, count(*) AS fragments, {num('min(rmsd)', 'least')}, {num('max(rmsd)', 'greatest')}, "
    f"{num('avg(rmsd)', 'mean')} FROM fit GROUP BY pid",
    _FRAGMENTS, Q.moments("frag", "pid, i0, j0"), Q.fit("pid, i0, j0")))
def fragment_rmsd(spark, sf):
    """RMSD of all fragment pairs of all requested pairs, summarised per pair."""
    return fragment_fits(spark, sf).groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("fragments"), F.min("frag_rmsd").alias("least"),
        F.max("frag_rmsd").alias("greatest"), F.avg("frag_rmsd").alias("mean"))


@register("top_fragments", Q.query(
    f"SELECT pid AS pair_id, i0, j0, {num('rmsd', 'frag_rmsd')}, rk AS place FROM ("
    "SELECT *, row_number() OVER (PARTITION BY pid ORDER BY rmsd, i0, j0) AS rk FROM fit) WHERE rk <= 5",
    _FRAGMENTS, Q.moments("frag", "pid, i0, j0"), Q.fit("pid, i0, j0")))
def top_fragments(spark, sf):
    """The five best superimposable fragment pairs of every requested pair."""
    order = W.partitionBy("pair_id").orderBy("frag_rmsd", "i0", "j0")
    ranked = fragment_fits(spark, sf).select("pair_id", "i0", "j0", "frag_rmsd").withColumn(
        "place", F.row_number().over(order))
    return ranked.filter("place <= 5")


@register("fragment_cut", Q.query(
    "SELECT pid AS pair_id, count(*) AS kept FROM fit WHERE rmsd <= 0.8 GROUP BY pid",
    _FRAGMENTS, Q.moments("frag", "pid, i0, j0"), Q.fit("pid, i0, j0")))
def fragment_cut(spark, sf):
    """Orientations left by a limit on the fragment RMSD."""
    starts = O.fragment_starts(paired(spark, sf), 4)
    return O.fragment_fits(starts, 4, max_frag_rmsd=0.8).groupBy("pair_id").agg(F.count(F.lit(1)).alias("kept"))


@register("fragment_orientations", Q.query(
    f"SELECT pid AS pair_id, count(*) AS orientations, {num('sum(m11 + m22 + m33)', 'traces', 2)}, "
    f"{num('sum(abs(m14) + abs(m24) + abs(m34))', 'shifts', 2)} FROM rot GROUP BY pid",
    _FRAGMENTS, Q.moments("frag", "pid, i0, j0"), Q.fit("pid, i0, j0"), Q.rotation("pid, i0, j0")))
def fragment_orientations(spark, sf):
    """Transforms of all fragment pairs, checked through sums per pair."""
    o = O.fragment_orientations(O.fragment_starts(paired(spark, sf), 4), 4)
    m = F.col("m")
    return o.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("orientations"), F.round(F.sum(m[0] + m[5] + m[10]), 2).alias("traces"),
        F.round(F.sum(F.abs(m[3]) + F.abs(m[7]) + F.abs(m[11])), 2).alias("shifts"))


@register("fragment_starts_band", Q.query(
    "SELECT pid AS pair_id, i AS i0, j AS j0 FROM cells WHERE i <= na - 4 AND j <= nb - 4 AND j - i BETWEEN -(na - 18) AND nb - 18"))
def fragment_starts_band(spark, sf):
    return O.fragment_starts(paired(spark, sf), 4, 18).select("pair_id", "i0", "j0")


_BOXES = """
sse AS (SELECT sid, k.kind, k.f, k.l FROM src, (VALUES ('HELIX', 2, 7), ('SHEET', 13, 17)) k(kind, f, l)),
box AS (SELECT r.pid, r.na, r.nb, s.kind, s.f AS af, s.l AS al, t.f AS bf, t.l AS bl FROM prs r
  JOIN sse s ON s.sid = r.a JOIN sse t ON t.sid = r.b AND t.kind = s.kind)"""


@register("sse_interval_pairs", Q.query(
    "SELECT pid AS pair_id, kind, af AS a_first, al AS a_last, bf AS b_first, bl AS b_last FROM box", _BOXES))
def interval_pairs(spark, sf):
    return sse_interval_pairs(bridge.sse(spark, sf), bridge.pairs(spark, sf))


@register("rectangle_starts", Q.query(
    "SELECT DISTINCT c.pid AS pair_id, c.i AS i0, c.j AS j0 FROM cells c JOIN ("
    "SELECT pid, af, al, bf, bl FROM box UNION ALL SELECT pid, 5, 12, 5, 12 FROM prs) b ON b.pid = c.pid "
    "AND c.i BETWEEN b.af AND least(b.al, c.na - 1) - 3 AND c.j BETWEEN b.bf AND least(b.bl, c.nb - 1) - 3 "
    "AND c.j - c.i BETWEEN -(c.na - 18) AND c.nb - 18", _BOXES))
def rectangle_starts(spark, sf):
    """Fragment starts inside helix, strand and user-given rectangles, each once."""
    boxes = sse_interval_pairs(bridge.sse(spark, sf), bridge.pairs(spark, sf)).drop("kind")
    five = bridge.pairs(spark, sf).select(
        "pair_id", F.lit(5).alias("a_first"), F.lit(12).alias("a_last"), F.lit(5).alias("b_first"), F.lit(12).alias("b_last"))
    return O.rectangle_starts(paired(spark, sf), boxes.unionByName(five), 4, 18)


@register("extend_intervals", Q.query(
    """SELECT sid AS structure_id, len, CASE WHEN d <= 0 THEN f WHEN ol > 0 AND orr > 0 THEN 0 ELSE greatest(0, greatest(0, f - pad) - orr) END AS first_pos,
  CASE WHEN d <= 0 THEN l WHEN ol > 0 AND orr > 0 THEN n - 1 ELSE least(n - 1, least(n - 1, l + pad) + ol) END AS last_pos
  FROM (SELECT *, greatest(0, pad - f) AS ol, greatest(0, pad - (n - 1 - l)) AS orr FROM (
    SELECT *, len - (l - f + 1) AS d, CAST(ceil((len - (l - f + 1)) / 2.0) AS BIGINT) AS pad FROM iv)) ORDER BY 1""",
    "iv AS (SELECT sid, n, len, f, f + sid % 5 AS l FROM (SELECT sid, n, (sid * 7) % 16 AS f FROM src), "
    "(SELECT unnest([4, 9, 15, 21]) AS len))"))
def extended(spark, sf):
    base = bridge.chains(spark, sf).select("structure_id", "n")
    first = F.pmod(F.col("structure_id") * 7, F.lit(16)).cast("int")
    iv = base.withColumn("first_pos", first).withColumn(
        "last_pos", first + F.pmod("structure_id", F.lit(5)).cast("int"))
    out = None
    for length in (4, 9, 15, 21):
        part = extend_intervals(iv, length).select("structure_id", F.lit(length).alias("len"), "first_pos", "last_pos")
        out = part if out is None else out.unionByName(part)
    return out


@register("default_orientations", Q.query(
    "SELECT pid AS pair_id, CASE WHEN pid % 2 = 0 THEN 'matrix' ELSE 'identity' END AS source, "
    "CASE WHEN pid % 2 = 0 THEN 4 ELSE 1 END AS orientations FROM prs"))
def default_orientations(spark, sf):
    """Pairs without any given orientation get the identity."""
    given = O.orientations_from_transforms(bridge.axis_orientations(spark, sf).filter("pair_id % 2 = 0"))
    return O.with_default(given, bridge.pairs(spark, sf)).groupBy("pair_id", "source").agg(
        F.count(F.lit(1)).alias("orientations"))


@register("orientations_from_matches", Q.query(
    f"SELECT pid AS pair_id, 0 AS o_id, 'matches' AS source, {num('rmsd', 'frag_rmsd')} FROM fit",
    Q.matched("rgt", "mp"), Q.moments("mp", "pid"), Q.fit("pid")))
def orientations_from_matches(spark, sf):
    fits = S.superpose(given_points(spark, sf, "right"), ["pair_id"], transform=True).withColumn("o_id", F.lit(0))
    return O.orientations_from_matches(fits).select("pair_id", "o_id", "source", "frag_rmsd")


@register("orientation_distance", Q.query(
    f"SELECT prs.b AS structure_id, t.o AS o_id, {num('sum(dx*dx + dy*dy)', 'direct', 3)}, {num('sum(dx*dx + dy*dy)', 'closed', 3)} "
    "FROM (SELECT axo.pid, o, (c-1)*x - s*y + o AS dx, s*x + (c-1)*y AS dy FROM axo JOIN prs USING (pid) JOIN pts ON pts.sid = prs.b) t "
    "JOIN prs USING (pid) GROUP BY ALL"))
def orientation_distance(spark, sf):
    """Displacement between the identity and each given transform, point by point and in closed form."""
    owners = bridge.pairs(spark, sf).select("pair_id", F.col("b").alias("structure_id"))
    both = bridge.axis_orientations(spark, sf).join(owners, "pair_id").select(
        "structure_id", "o_id", G.identity().alias("m1"), F.col("m").alias("m2"))
    points = bridge.points(spark, sf)
    direct = CMP.direct_displacement(both, points, "structure_id").withColumnRenamed("ssd", "direct")
    closed = both.join(C.structure_moments(points), "structure_id").select(
        "structure_id", "o_id", G.displacement_ssd(F.col("m1"), F.col("m2"), F.col("w")).alias("closed"))
    return direct.join(closed, ["structure_id", "o_id"]).select(
        "structure_id", "o_id", F.round("direct", 3).alias("direct"), F.round("closed", 3).alias("closed"))


@register("value_histogram", """
SELECT l_returnflag AS flag, CAST(floor((l_discount - 0.0) / (0.1 - 0.0) * 7) AS BIGINT) AS bin, count(*) AS "values"
FROM lineitem WHERE l_discount >= 0.0 AND l_discount < 0.1 GROUP BY ALL""")
def value_histogram(spark, sf):
    rows = bridge.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_discount")
    return H.histogram(rows, "l_discount", 0.0, 0.1, 7, ["flag"])


@register("close_pairs", Q.query(
    f"SELECT pid AS pair_id, i, j, {num('d2', 'd2')} FROM (SELECT *, (ax-bx)*(ax-bx) + (ay-by_)*(ay-by_) + (az-bz)*(az-bz) AS d2 "
    "FROM cells) WHERE d2 <= 36 AND j - i BETWEEN -(na - 7) AND nb - 7"))
def close_pairs(spark, sf):
    """Residue pairs within a distance of 6 that can be part of 7 ordered matches, met in cells of a grid."""
    return H.pair_distances(paired(spark, sf), 7, 6.0, grid_from=0)

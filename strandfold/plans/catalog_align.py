"""Queries over alignments at fixed orientations, searches, ranked solutions and refinement."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandfold.operators import align as A
from strandfold.operators import chains as C
from strandfold.operators import histogram as H
from strandfold.operators import orient as O
from strandfold.operators import refine as R
from strandfold.operators import solutions as SOL
from strandfold.operators import superpose as S
from strandfold.plans import bridge, search
from strandfold.plans import oracle as Q
from strandfold.plans.catalog_geometry import paired
from strandfold.plans.registry import register
from strandfold.session import cut_lineage, scratch_path
from strandfold.streaming.best import run_best

num = Q.num


def identity_blocks(spark, sf):
    chains = paired(spark, sf)
    none = O.orientations_from_transforms(bridge.axis_orientations(spark, sf).filter("o_id < 0"))
    return A.orientation_blocks(O.with_default(none, chains), chains)


def axis_blocks(spark, sf):
    given = O.orientations_from_transforms(bridge.axis_orientations(spark, sf))
    return A.orientation_blocks(given, paired(spark, sf))


_D2 = "(ax-bx)*(ax-bx) + (ay-by_)*(ay-by_) + (az-bz)*(az-bz)"
_COST = f"cost AS (SELECT pid AS g, i, j, na, nb, {_D2} AS c FROM cells)"
_LAST = "fin AS (SELECT l.g AS pid, l.n, l.s, na, nb FROM lay l JOIN prs ON prs.pid = l.g WHERE l.i = na - 1 AND l.j = nb - 1)"


@register("layered_identity", Q.query(
    f"SELECT pid AS pair_id, n, {num('s', 'ssd')}, {num('sqrt(s / n)', 'rmsd')} FROM fin WHERE n >= 2",
    _COST, Q.layers("cost"), _LAST, recursive=True))
def layered_identity(spark, sf):
    """For every pair as placed and every n, the least cost of n ordered matches."""
    out = A.layered_align(identity_blocks(spark, sf), A.Search(refine=False))
    return out.select("pair_id", "n", "ssd", "rmsd")


@register("layered_matches_consistent", Q.query(
    "SELECT pid AS pair_id, true AS consistent, CAST(least(na, nb) - 1 AS BIGINT) AS solutions FROM prs"))
def layered_matches_consistent(spark, sf):
    """The reported matches add up to the reported cost, have n pairs and increase on both chains."""
    out = A.layered_align(identity_blocks(spark, sf), A.Search(refine=False))
    joined = out.join(paired(spark, sf), "pair_id")
    at = lambda s, v, i: F.col(f"{s}{v}")[i]
    cost = F.aggregate("matches", F.lit(0.0), lambda acc, p: acc + sum(
        (at("a", v, p["i"]) - at("b", v, p["j"])) * (at("a", v, p["i"]) - at("b", v, p["j"])) for v in "xyz"))
    steps = F.zip_with(
        F.slice("matches", 1, F.size("matches") - 1), F.slice("matches", 2, F.size("matches")),
        lambda p, q: (p["i"] < q["i"]) & (p["j"] < q["j"]))
    ok = (F.abs(cost - F.col("ssd")) < 1e-6) & (F.size("matches") == F.col("n")) & F.forall(steps, lambda v: v)
    return joined.groupBy("pair_id").agg(F.bool_and(ok).alias("consistent"), F.count(F.lit(1)).alias("solutions"))


@register("layered_limits", Q.query(
    f"SELECT pid AS pair_id, n, {num('s', 'ssd')} FROM ("
    "SELECT *, max(CASE WHEN s > 1e20 OR (n >= 3 AND sqrt(s / n) > 3.0) THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY n) AS bad "
    "FROM fin WHERE n >= 2) WHERE bad = 0 AND n >= 3",
    f"cost AS (SELECT pid AS g, i, j, na, nb, CASE WHEN {_D2} > 25 THEN 1e26 ELSE {_D2} END AS c FROM cells)",
    Q.layers("cost"), _LAST, recursive=True))
def layered_limits(spark, sf):
    """The same with limits: the first n over a limit ends a pair."""
    out = A.layered_align(
        identity_blocks(spark, sf), A.Search(n_min=3, max_dist=5.0, max_rmsd=3.0, refine=False))
    return out.select("pair_id", "n", "ssd")


_AXIS_CELLS = """
acells AS (SELECT pid, o, i, j, na, nb, (c*bx - s*by_ + o - ax)*(c*bx - s*by_ + o - ax)
  + (s*bx + c*by_ - ay)*(s*bx + c*by_ - ay) + (bz - az)*(bz - az) AS d2 FROM cells JOIN axo USING (pid))"""
_REACH = """
grid AS (SELECT pid * 4 + o AS g, i, j, d2 FROM acells),
lcs AS (SELECT g, CAST(-1 AS BIGINT) AS i, j, CAST(0 AS BIGINT) AS v FROM grid WHERE i = 0
  UNION ALL
  SELECT g, i, j, max(v) OVER (PARTITION BY g ORDER BY j) AS v FROM (
    SELECT c.g, c.i, c.j, greatest(l.v, coalesce(p.v, 0) + CASE WHEN c.d2 <= 16 THEN 1 ELSE 0 END) AS v
    FROM lcs l JOIN grid c ON c.g = l.g AND c.i = l.i + 1 AND c.j = l.j
    LEFT JOIN lcs p ON p.g = l.g AND p.j = l.j - 1 AND p.i = l.i)),
rch AS (SELECT l.g // 4 AS pid, l.g % 4 AS o, max(l.v) AS reach FROM lcs l JOIN prs ON prs.pid = l.g // 4
  WHERE l.i = na - 1 GROUP BY ALL)"""


@register("reachable_matches", Q.query(
    "SELECT pid AS pair_id, o AS o_id, reach FROM rch", _AXIS_CELLS, _REACH, recursive=True))
def reachable_matches(spark, sf):
    """Most ordered matches within distance 4, for four given orientations of every pair."""
    return A.reachable_matches(axis_blocks(spark, sf), 4.0).drop("n_most")


@register("orientation_filter", Q.query(
    "SELECT r.pid AS pair_id, o AS o_id, reach FROM rch r JOIN prs USING (pid) WHERE reach >= floor(0.33 * least(na, nb) + 0.5)",
    _AXIS_CELLS, _REACH, recursive=True))
def orientation_filter(spark, sf):
    return A.orientation_filter(axis_blocks(spark, sf), 4.0, 0.33)


@register("most_matches_within", Q.query(
    "SELECT pid AS pair_id, o AS o_id, reach AS n FROM rch WHERE reach > 0", _AXIS_CELLS, _REACH, recursive=True))
def most_matches_within(spark, sf):
    """The single-answer form of the same question."""
    return A.gap_align(axis_blocks(spark, sf), max_dist=4.0).select("pair_id", "o_id", "n")


@register("gap_align", Q.query(
    f"SELECT l.g // 4 AS pair_id, l.g % 4 AS o_id, {num('l.v + (na + nb) * 9.0', 'cost')} FROM nw l JOIN prs ON prs.pid = l.g // 4 "
    "WHERE l.i = na - 1 AND l.j = nb - 1 AND l.v < 0",
    _AXIS_CELLS, """
grid AS (SELECT pid * 4 + o AS g, i, j, d2 FROM acells),
nw AS (SELECT g, CAST(-1 AS BIGINT) AS i, j, CAST(0 AS DOUBLE) AS v FROM grid WHERE i = 0
  UNION ALL
  SELECT g, i, j, min(v) OVER (PARTITION BY g ORDER BY j) AS v FROM (
    SELECT c.g, c.i, c.j, least(l.v, coalesce(p.v, 0) + c.d2 - 18, 0) AS v
    FROM nw l JOIN grid c ON c.g = l.g AND c.i = l.i + 1 AND c.j = l.j
    LEFT JOIN nw p ON p.g = l.g AND p.j = l.j - 1 AND p.i = l.i))""", recursive=True))
def gap_align(spark, sf):
    """Cheapest alignment at a price of 9 per unmatched residue, for four orientations of every pair."""
    return A.gap_align(axis_blocks(spark, sf), gap=9.0).select("pair_id", "o_id", "cost")


# Corners of the convex hull of (n, least cost) per orientation: the answers that some price yields, and up to which price.
_CORNERS = ("""
cost AS (SELECT pid * 4 + o AS g, i, j, na, nb, d2 AS c FROM acells)""", Q.layers("cost"), """
ends AS (SELECT l.g, l.n, l.s, least(na, nb) AS width FROM lay l JOIN prs ON prs.pid = l.g // 4 WHERE l.i = na - 1 AND l.j = nb - 1),
hull AS (SELECT p.g, p.n, p.s, p.width, max((p.s - q.s) / (p.n - q.n)) FILTER (q.n < p.n) AS before,
  min((q.s - p.s) / (q.n - p.n)) FILTER (q.n > p.n) AS after
  FROM ends p JOIN (SELECT g, n, s FROM ends UNION ALL SELECT DISTINCT g, 0, 0.0 FROM ends) q ON q.g = p.g AND q.n <> p.n GROUP BY ALL),
corners AS (SELECT h.g // 4 AS pid, h.g % 4 AS o, n, s, coalesce(after / 2, top * width + 1) AS price, width
  FROM hull h JOIN (SELECT g, max(c) AS top FROM cost GROUP BY g) USING (g) WHERE after IS NULL OR before < after)""")


def _target_sql(allowed: str) -> str:
    final = (
        f"SELECT pid AS pair_id, o AS o_id, n, {num('price', 'gap')}, {num('s', 'ssd')}, {num('sqrt(s / n)', 'rmsd')} FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY pid ORDER BY n DESC, s, o) AS rk FROM corners WHERE {allowed}) WHERE rk = 1")
    return Q.query(final, _AXIS_CELLS, *_CORNERS, recursive=True)


@register("gap_align_target_rmsd", _target_sql("sqrt(s / n) <= 3.0"))
def gap_align_target_rmsd(spark, sf):
    """Per pair the most matches that a price yields within an rmsd of 3, over four given orientations."""
    out = A.best_single_answer(A.gap_align(axis_blocks(spark, sf), target_rmsd=3.0))
    return out.select("pair_id", "o_id", "n", "gap", "ssd", "rmsd")


@register("gap_align_target_n", _target_sql("n <= floor(0.5 * width + 0.5)"))
def gap_align_target_n(spark, sf):
    """Per pair the most matches that a price yields, up to half of the shorter chain."""
    out = A.best_single_answer(A.gap_align(axis_blocks(spark, sf), target_n=0.5))
    return out.select("pair_id", "o_id", "n", "gap", "ssd", "rmsd")


@register("refine_single")
def refine_single(spark, sf):
    """Single answers refined by superimposing and aligning again."""
    chains = cut_lineage(paired(spark, sf))
    given = O.orientations_from_transforms(bridge.axis_orientations(spark, sf))
    first = A.best_single_answer(A.gap_align(A.orientation_blocks(given, chains), max_dist=5.0, refine=True))
    return R.refine_single(first, chains, max_dist=5.0).select("pair_id", "n", "ssd", "rmsd")


@register("search_best")
def search_best(spark, sf):
    """The whole search: all fragment orientations, all n, best per n with intermediate refinement."""
    return search.best_solutions(paired(spark, sf), A.Search(n_min=0.33)).select("pair_id", "n", "ssd", "rmsd")


@register("search_filtered")
def search_filtered(spark, sf):
    """The search with the usual limits: orientation filter, least n, rmsd limit."""
    wanted = A.Search(n_min=0.33, max_rmsd=3.5, prefilter=(8.0, 0.33))
    return search.best_solutions(paired(spark, sf), wanted).select("pair_id", "n", "ssd", "rmsd")


@register("search_intervals")
def search_intervals(spark, sf):
    """The search restricted to orientations from helix and strand interval pairs, without refinement."""
    from strandfold.operators.select import sse_interval_pairs

    boxes = sse_interval_pairs(bridge.sse(spark, sf), bridge.pairs(spark, sf))
    wanted = A.Search(n_min=5, refine=False, prefilter=(6.0, 7))
    return search.best_solutions(paired(spark, sf), wanted, rectangles=boxes).select("pair_id", "n", "ssd", "rmsd")


@register("refine_best")
def refine_best(spark, sf):
    """Best solutions per n refined to a fixed point."""
    chains = cut_lineage(paired(spark, sf))
    given = O.orientations_from_transforms(bridge.axis_orientations(spark, sf))
    wanted = A.Search(n_min=0.5)
    first = SOL.best_per_n(A.layered_align(A.orientation_blocks(given, chains), wanted))
    return R.refine(first, chains, wanted).select("pair_id", "n", "ssd", "rmsd")


@register("refine_all_ranks")
def refine_all_ranks(spark, sf):
    """Two mutually different solutions per n, each refined, then pruned again."""
    chains = cut_lineage(paired(spark, sf))
    given = O.orientations_from_transforms(bridge.axis_orientations(spark, sf))
    wanted = A.Search(n_min=0.8, keep="all")
    candidates = A.layered_align(A.orientation_blocks(given, chains), wanted)
    ranked = SOL.alternatives(candidates, 2, SOL.similar_pairs(5))
    refined = R.refine_ranks(ranked, chains, wanted)
    pruned = SOL.prune_alternatives(refined, SOL.similar_pairs(5))
    return pruned.select("pair_id", "n", "rank", "ssd", "rmsd")


@register("best_per_n", """
SELECT l_suppkey AS pair_id, CAST(l_linenumber AS BIGINT) AS n, round(ssd, 4) + 0.0 AS ssd, o_id FROM (
  SELECT l_suppkey, l_linenumber, l_extendedprice AS ssd, l_orderkey AS o_id,
    row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_extendedprice, l_orderkey) AS rk FROM lineitem)
WHERE rk = 1""")
def best_per_n(spark, sf):
    return SOL.best_per_n(bridge.line_candidates(spark, sf))


@register("stream_best", """
SELECT l_suppkey AS pair_id, CAST(l_linenumber AS BIGINT) AS n, round(ssd, 4) + 0.0 AS ssd, o_id FROM (
  SELECT l_suppkey, l_linenumber, l_extendedprice AS ssd, l_orderkey AS o_id,
    row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_extendedprice, l_orderkey) AS rk FROM lineitem)
WHERE rk = 1""")
def stream_best(spark, sf):
    """The same table kept up to date over a stream of candidate files."""
    schema = bridge.table(spark, sf, "lineitem").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    candidates = lines.select(
        F.col("l_suppkey").alias("pair_id"), F.col("l_linenumber").cast("int").alias("n"),
        F.col("l_orderkey").alias("o_id"), F.col("l_extendedprice").alias("ssd"))
    return run_best(candidates, scratch_path(spark, "best-log"), scratch_path(spark, "best-state"))


_LINES = """
cand AS (SELECT l_suppkey AS pid, CAST(l_linenumber AS BIGINT) AS n, l_orderkey AS o, l_extendedprice AS ssd FROM lineitem)"""


@register("within_ratio", Q.query(
    "SELECT pid AS pair_id, n, count(*) AS kept FROM (SELECT *, min(ssd) OVER (PARTITION BY pid, n) AS least FROM cand) "
    "WHERE ssd <= least * 9 GROUP BY ALL", _LINES))
def within_ratio(spark, sf):
    return SOL.within_ratio(bridge.line_candidates(spark, sf), 3.0).groupBy("pair_id", "n").agg(
        F.count(F.lit(1)).alias("kept"))


@register("orientations_in_use", Q.query(
    "SELECT DISTINCT pid AS pair_id, o AS o_id FROM (SELECT *, min(ssd) OVER (PARTITION BY pid, n) AS least FROM cand) "
    "WHERE ssd <= least * 4", _LINES))
def orientations_in_use(spark, sf):
    return SOL.orientations_in_use(bridge.line_candidates(spark, sf), 2.0)


@register("winning_orientations", Q.query(
    "SELECT pid AS pair_id, o AS o_id, count(*) AS slots, min(n) AS n_first, max(n) AS n_last FROM ("
    "SELECT *, row_number() OVER (PARTITION BY pid, n ORDER BY ssd, o) AS rk FROM cand) WHERE rk = 1 GROUP BY ALL", _LINES))
def winning_orientations(spark, sf):
    return SOL.winning_orientations(SOL.best_per_n(bridge.line_candidates(spark, sf)))


@register("prefix_valid", Q.query(
    "SELECT pid AS pair_id, o AS o_id, n FROM (SELECT pid, o, n, max(CASE WHEN worst > 50000 THEN 1 ELSE 0 END) "
    "OVER (PARTITION BY pid, o ORDER BY n) AS bad FROM (SELECT pid, o, n, max(ssd) AS worst FROM cand GROUP BY ALL)) WHERE bad = 0",
    _LINES))
def prefix_valid(spark, sf):
    slots = bridge.line_candidates(spark, sf).groupBy("pair_id", "o_id", "n").agg(F.max("ssd").alias("ssd"))
    return SOL.prefix_valid(slots, F.col("ssd") > 50000).select("pair_id", "o_id", "n")


@register("depth_histogram", Q.query(
    "SELECT last_n, count(*) AS orientations, CAST(sum(count(*)) OVER (ORDER BY last_n DESC) AS BIGINT) AS at_least FROM ("
    "SELECT pid, o, max(n) AS last_n FROM cand GROUP BY ALL) GROUP BY last_n", _LINES))
def depth_histogram(spark, sf):
    return SOL.depth_histogram(bridge.line_candidates(spark, sf))


_SHIFTS = """
fr AS (SELECT s.pid, s.i AS i0, s.j AS j0, avg(c.ax - c.bx) AS tx, avg(c.ay - c.by_) AS ty, avg(c.az - c.bz) AS tz,
  sum((c.ax-c.bx)*(c.ax-c.bx) + (c.ay-c.by_)*(c.ay-c.by_) + (c.az-c.bz)*(c.az-c.bz)) AS raw, any_value(s.nb) AS nb
  FROM cells s JOIN (SELECT unnest(range(4)) AS t) ON TRUE JOIN cells c ON c.pid = s.pid AND c.i = s.i + t AND c.j = s.j + t
  WHERE s.i <= s.na - 4 AND s.j <= s.nb - 4 GROUP BY s.pid, s.i, s.j),
c0 AS (SELECT pid, i0, j0, i0 * 1000 + j0 AS o, tx, ty, tz, nb, greatest(raw - 4 * (tx*tx + ty*ty + tz*tz), 0) AS ssd FROM fr)"""
_SHIFT_DISTANCE = "(c.tx-w.tx)*(c.tx-w.tx) + (c.ty-w.ty)*(c.ty-w.ty) + (c.tz-w.tz)*(c.tz-w.tz)"


def _rounds(count: int, alike: str, start: str = "c0") -> list[str]:
    """Unrolled greedy rounds: w<k> are the winners of round k, c<k> what is left after it."""
    out = []
    for k in range(1, count + 1):
        source = start if k == 1 else f"c{k - 1}"
        out.append(f"w{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY ssd, o) AS rk FROM {source}) WHERE rk = 1)")
        out.append(f"c{k} AS (SELECT c.* FROM {source} c JOIN w{k} w USING (pid) WHERE c.o <> w.o AND NOT ({alike}))")
    out.append("win AS (" + " UNION ALL ".join(f"SELECT pid, {k} AS rank, o, ssd FROM w{k}" for k in range(1, count + 1)) + ")")
    return out


_WIN = f"SELECT pid AS pair_id, 4 AS n, CAST(rank AS BIGINT) AS rank, o AS o_id, {num('ssd', 'ssd')} FROM win"


def moments_of_b(spark, sf):
    w = C.structure_moments(bridge.points(spark, sf)).withColumnRenamed("structure_id", "b")
    return bridge.pairs(spark, sf).join(w, "b").select("pair_id", "w")


@register("alternatives_orientation", Q.query(_WIN, _SHIFTS, *_rounds(3, f"{_SHIFT_DISTANCE} < 9.0")))
def alternatives_orientation(spark, sf):
    """Three best candidates per pair that displace b by at least 3 against each other."""
    light = bridge.shift_candidates(spark, sf).drop("matches")
    out = SOL.alternatives(light, 3, SOL.similar_orientation(3.0), moments=moments_of_b(spark, sf))
    return out.select("pair_id", "n", "rank", "o_id", "ssd")


_COMMON = "c.i0 - c.j0 = w.i0 - w.j0 AND 4 - abs(c.i0 - w.i0) > 1"


@register("alternatives_pairs", Q.query(
    _WIN, _SHIFTS, "cr AS (SELECT * FROM (SELECT *, min(ssd) OVER (PARTITION BY pid) AS least FROM c0) WHERE ssd <= least * 25)",
    *_rounds(3, _COMMON, "cr")))
def alternatives_pairs(spark, sf):
    """Three best candidates per pair, at most 5 times the best rmsd, that share at most one matched pair."""
    light = bridge.shift_candidates(spark, sf).drop("m")
    return SOL.alternatives(light, 3, SOL.similar_pairs(1), rmsd_ratio=5.0).select("pair_id", "n", "rank", "o_id", "ssd")


@register("prune_alternatives", Q.query(
    _WIN, _SHIFTS,
    "ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY ssd, o) AS place FROM c0) WHERE place <= 5)",
    "cr AS (SELECT * EXCLUDE (place) FROM (SELECT *, min(ssd) OVER (PARTITION BY pid) AS least FROM ranked) WHERE ssd <= least * 16)",
    *_rounds(5, f"{_SHIFT_DISTANCE} < 4.0", "cr")))
def prune_alternatives(spark, sf):
    """The five best candidates per pair, pruned to different ones within 4 times the best rmsd."""
    order = W.partitionBy("pair_id", "n").orderBy("ssd", "o_id")
    ranked = bridge.shift_candidates(spark, sf).withColumn("rank", F.row_number().over(order)).filter("rank <= 5")
    return SOL.prune_alternatives(
        ranked, SOL.similar_orientation(2.0), rmsd_ratio=4.0, moments=moments_of_b(spark, sf)
    ).select("pair_id", "n", "rank", "o_id", "ssd")


def interval_alternatives(spark, sf):
    """(chains, search, three different solutions per n, without matches) from the interval orientations."""
    from strandfold.operators.select import sse_interval_pairs

    boxes = sse_interval_pairs(bridge.sse(spark, sf), bridge.pairs(spark, sf))
    chains = cut_lineage(paired(spark, sf))
    wanted = A.Search(n_min=0.8, keep="all", matches=False)
    found = search.candidates(chains, wanted, rectangles=boxes)
    out = SOL.alternatives(found, 3, SOL.similar_orientation(4.0), rmsd_ratio=2.0, moments=moments_of_b(spark, sf))
    return chains, wanted, out


@register("search_alternatives")
def search_alternatives(spark, sf):
    """Three mutually different solutions per n from the interval orientations of the whole search."""
    return interval_alternatives(spark, sf)[2].select("pair_id", "n", "rank", "ssd", "rmsd")


def consistent(solutions, chains, keys):
    """Per solution whether its matches are n, increase on both chains and superimpose to its ssd."""
    steps = F.zip_with(
        F.slice("matches", 1, F.size("matches") - 1), F.slice("matches", 2, F.size("matches")),
        lambda p, q: (p["i"] < q["i"]) & (p["j"] < q["j"]))
    fits = S.superpose(S.listed_points(solutions, chains, keys), ["pair_id", *keys]).select("pair_id", *keys, F.col("ssd").alias("_ssd"))
    # judged before the join, so that no matches go through it unless the caller reads them
    ordered = solutions.withColumn("_ordered", (F.size("matches") == F.col("n")) & F.forall(steps, lambda v: v))
    close = F.abs(F.col("ssd") - F.col("_ssd")) <= 1e-6 * (1 + F.col("ssd"))
    joined = ordered.join(fits, ["pair_id", *keys], "left")
    return joined.withColumn("good", F.col("_ordered") & F.coalesce(close, F.lit(False))).drop("_ordered")


# With all residues of equally long chains matched there is one match set, and SQL can superimpose it.
_WHOLE = ("whole AS (SELECT pid, ax, ay, az, bx, by_, bz FROM cells WHERE i = j)", Q.moments("whole", "pid"), Q.fit("pid"))


@register("alternatives_solved", Q.query(
    f"SELECT pid AS pair_id, 5 AS winners, TRUE AS consistent, {num('ssd', 'whole_ssd')} FROM fit", *_WHOLE))
def alternatives_solved(spark, sf):
    """The best alternative per n gets its matches by solving the winning orientations once more; checked against its ssd."""
    chains, wanted, out = interval_alternatives(spark, sf)
    # both the solver and the check read their rows more than once
    winners = cut_lineage(out.filter("rank = 1"))
    solved = cut_lineage(A.winners_solved(winners, chains, wanted, 4))
    return consistent(solved, chains, ["n"]).groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("winners"), F.bool_and("good").alias("consistent"), F.min_by("ssd", -F.col("n")).alias("whole_ssd"))


@register("search_best_checked", Q.query(
    f"SELECT pid AS pair_id, 15 AS solutions, TRUE AS consistent, {num('ssd', 'whole_ssd')} FROM fit", *_WHOLE))
def search_best_checked(spark, sf):
    """The whole search once more: all n from 7 up, matches in order, their superposition, and the one match set of n = 21."""
    chains = cut_lineage(paired(spark, sf))
    # the check reads the solutions more than once
    found = cut_lineage(search.best_solutions(chains, A.Search(n_min=0.33)))
    return consistent(found, chains, ["n"]).groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("solutions"), F.bool_and("good").alias("consistent"), F.min_by("ssd", -F.col("n")).alias("whole_ssd"))


@register("refine_best_checked", Q.query(
    f"SELECT pid AS pair_id, 11 AS solutions, TRUE AS consistent, {num('ssd', 'whole_ssd')} FROM fit", *_WHOLE))
def refine_best_checked(spark, sf):
    """Refined solutions of all n from 11 up, checked in the same way."""
    chains = cut_lineage(paired(spark, sf))
    given = O.orientations_from_transforms(bridge.axis_orientations(spark, sf))
    wanted = A.Search(n_min=0.5)
    refined = R.refine(SOL.best_per_n(A.layered_align(A.orientation_blocks(given, chains), wanted)), chains, wanted)
    return consistent(refined, chains, ["n"]).groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("solutions"), F.bool_and("good").alias("consistent"), F.min_by("ssd", -F.col("n")).alias("whole_ssd"))


_MIXED = (Q.matched("lft", "lm"), Q.moments("lm", "pid"), Q.fit("pid"), Q.rotation("pid"), """
ori AS (SELECT pid, 1 AS source, 0 AS o, m11, m12, m13, m14, m21, m22, m23, m24, m31, m32, m33, m34 FROM rot WHERE pid % 3 < 2
  UNION ALL SELECT pid, 2, o, c, -s, 0, o, s, c, 0, 0, 0, 0, 1, 0 FROM axo WHERE pid % 3 = 1
  UNION ALL SELECT pid, 3, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0 FROM prs WHERE pid % 3 = 2),
moved AS (SELECT pid * 16 + source * 4 + o AS g, i, j, na, nb, ax, ay, az, m11*bx + m12*by_ + m13*bz + m14 AS x,
  m21*bx + m22*by_ + m23*bz + m24 AS y, m31*bx + m32*by_ + m33*bz + m34 AS z FROM ori JOIN cells USING (pid)),
cost AS (SELECT g, i, j, na, nb, (ax-x)*(ax-x) + (ay-y)*(ay-y) + (az-z)*(az-z) AS c FROM moved)""", Q.layers("cost"), """
fin AS (SELECT l.g // 16 AS pid, l.g % 16 AS o, l.n, l.s FROM lay l JOIN prs ON prs.pid = l.g // 16
  WHERE l.i = na - 1 AND l.j = nb - 1 AND l.n >= floor(0.33 * least(na, nb) + 0.5))""")


@register("search_mixed", Q.query(
    f"SELECT pid AS pair_id, n, {num('s', 'ssd')}, {num('sqrt(s / n)', 'rmsd')}, "
    "['matches', 'matrix', 'identity'][CAST(o // 4 AS BIGINT)] AS source "
    "FROM (SELECT *, row_number() OVER (PARTITION BY pid, n ORDER BY s, o) AS rk FROM fin) WHERE rk = 1", *_MIXED, recursive=True))
def search_mixed(spark, sf):
    """Orientations from known alignments, given transforms or, without either, as placed; scored where they stand."""
    chains = cut_lineage(paired(spark, sf))
    known = bridge.given_matches(spark, sf, "left").filter("pair_id % 3 < 2").withColumn("o_id", F.lit(0).cast("long"))
    given = bridge.axis_orientations(spark, sf).filter("pair_id % 3 = 1")
    wanted = A.Search(n_min=0.33, refine=False, matches=False)
    found = search.mixed_candidates(chains, wanted, length=None, matches=known, transforms=given)
    return SOL.best_per_n(found).select("pair_id", "n", "ssd", "rmsd", "source")


@register("search_mixed_sources", Q.query(
    "SELECT pid AS pair_id, CASE WHEN pid % 3 < 2 THEN 1 ELSE 0 END AS from_matches, CASE WHEN pid % 3 = 1 THEN 4 ELSE 0 END AS "
    "from_matrices, CASE WHEN least(na, nb) < 4 AND pid % 3 = 2 THEN 1 ELSE 0 END AS from_identity, "
    "greatest(na - 3, 0) * greatest(nb - 3, 0) AS from_fragments FROM prs"))
def search_mixed_sources(spark, sf):
    """How many orientations of every source a search over all sources aligns: all that the pair has."""
    chains = cut_lineage(paired(spark, sf))
    known = bridge.given_matches(spark, sf, "left").filter("pair_id % 3 < 2").withColumn("o_id", F.lit(0).cast("long"))
    given = bridge.axis_orientations(spark, sf).filter("pair_id % 3 = 1")
    wanted = A.Search(n_min=2, n_max=2, refine=False, keep="all", matches=False)
    found = search.mixed_candidates(chains, wanted, matches=known, transforms=given)
    names = {"from_matches": "matches", "from_matrices": "matrix", "from_identity": "identity", "from_fragments": "fragment"}
    return found.groupBy("pair_id").agg(*[F.count_if(F.col("source") == v).alias(k) for k, v in names.items()])


_SERIES = """
ser AS (SELECT l_suppkey AS pid, CAST(l_quantity AS BIGINT) AS n, avg(l_extendedprice) AS sim, min(l_extendedprice) AS p FROM lineitem GROUP BY ALL)"""


def series(spark, sf):
    return bridge.table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("pair_id"), F.col("l_quantity").cast("int").alias("n")
    ).agg(F.avg("l_extendedprice").alias("similarity"), F.min("l_extendedprice").alias("p_str"))


@register("best_match", Q.query(
    f"SELECT pid AS pair_id, n, {num('sim', 'similarity', 2)} FROM ("
    "SELECT *, row_number() OVER (PARTITION BY pid ORDER BY sim DESC, n) AS rk FROM ser) WHERE rk = 1", _SERIES))
def best_match(spark, sf):
    out = SOL.best_match(series(spark, sf), "similarity", ["pair_id"])
    return out.select("pair_id", "n", F.round("similarity", 2).alias("similarity"))


@register("best_by_probability", Q.query(
    f"SELECT pid AS pair_id, n, {num('p', 'p_str')} FROM ("
    "SELECT *, row_number() OVER (PARTITION BY pid ORDER BY p, n) AS rk FROM ser WHERE n >= 20) WHERE rk = 1", _SERIES))
def best_by_probability(spark, sf):
    return SOL.best_by_probability(series(spark, sf), ["pair_id"]).select("pair_id", "n", "p_str")


_PAIRS = """
hits AS (SELECT l_suppkey AS c, CAST(l_linenumber AS BIGINT) AS rank, l_partkey % 10 AS i, CAST(l_quantity AS BIGINT) % 10 AS j,
  CAST(l_quantity AS BIGINT) AS n, l_extendedprice AS p FROM lineitem)"""


def hits(spark, sf):
    q = F.col("l_quantity").cast("int")
    return bridge.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("case_id"), F.col("l_linenumber").cast("int").alias("rank"),
        F.pmod("l_partkey", F.lit(10)).cast("int").alias("i"), (q % 10).alias("j"),
        q.alias("n"), F.col("l_extendedprice").alias("p_str"))


@register("pair_histogram", Q.query(
    "SELECT c AS case_id, rank, i, j, count(*) AS alignments FROM hits GROUP BY GROUPING SETS ((c, rank, i, j), (c, i, j))", _PAIRS))
def pair_histogram(spark, sf):
    return H.pair_histogram(hits(spark, sf), "case_id")


@register("pair_histogram_dense", Q.query(
    "SELECT g.c AS case_id, g.i, string_agg(coalesce(k.v, 0)::VARCHAR, ' ' ORDER BY g.j) AS line FROM ("
    "SELECT * FROM (SELECT DISTINCT c FROM hits), (SELECT unnest(range(10)) AS i), (SELECT unnest(range(10)) AS j)) g "
    "LEFT JOIN (SELECT c, i, j, count(*) AS v FROM hits GROUP BY ALL) k ON k.c = g.c AND k.i = g.i AND k.j = g.j GROUP BY g.c, g.i",
    _PAIRS))
def pair_histogram_dense(spark, sf):
    counts = H.pair_histogram(hits(spark, sf), "case_id").filter("rank IS NULL").drop("rank")
    sizes = counts.select("case_id").distinct().select("case_id", F.lit(10).alias("na"), F.lit(10).alias("nb"))
    return H.dense_rows(counts, sizes, ["case_id"], "case_id")


@register("pair_best_score", Q.query(
    f"SELECT c AS case_id, i, j, {num('min(p)', 'p_best')} FROM hits WHERE n >= 30 GROUP BY ALL", _PAIRS))
def pair_best_score(spark, sf):
    return H.pair_best_score(hits(spark, sf), "case_id")

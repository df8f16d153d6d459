"""Residue selections: the range language, interval membership, filtered structure files."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandfold.functions.skew import spread_join
from strandfold.operators.chains import RES_ID, hot_structures, renumbered
from strandfold.sources.structures import INTERVAL_FIELDS, atom_residue, interval_end, record_kind

# One term of a selection: [first[code]][-last[code]][.chain[-chain]], "*" for an open end.
_RESIDUE = r"(?:(\*)|(-?\d+)([^\s.,\-\d*])?)"
_TERM = re.compile(rf"^(?:{_RESIDUE}(?:-{_RESIDUE})?)?(?:\.(?:(.)(?:-(.))?)?)?$")


@dataclass(frozen=True)
class Term:
    """Bounds of one term; None means open."""

    first: tuple[int, str | None] | None
    last: tuple[int, str | None] | None
    first_chain: str | None
    last_chain: str | None


def parse_selection(spec: str) -> list[Term]:
    """Terms of a selection such as ``100-150.A,*.B-D``; an empty text selects everything."""
    terms = []
    for text in spec.split(","):
        found = _TERM.match(text.strip())
        if not found:
            raise ValueError(f"cannot read selection term {text!r}")
        star1, no1, code1, star2, no2, code2, chain1, chain2 = found.groups()
        first = None if no1 is None else (int(no1), code1)
        if star2 or no2 is not None:
            last = None if star2 else (int(no2), code2)
        else:
            last = first
        open_chain = chain1 in (None, "*")
        terms.append(Term(
            first, last, None if open_chain else chain1,
            None if (chain2 == "*" or (chain2 is None and open_chain)) else (chain2 or chain1),
        ))
    return terms


def _chain_runs(residues: DataFrame) -> DataFrame:
    """One row per run of equal chain ids of a structure, with its residues in order."""
    order = W.partitionBy("structure_id").orderBy("pos")
    new_run = (~F.col("chain_id").eqNullSafe(F.lag("chain_id").over(order))).cast("int")
    runs = residues.withColumn("_new", new_run).withColumn("run", F.sum("_new").over(order))
    return runs.groupBy("structure_id", "run", "chain_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "seq_num", "insert_code"))).alias("rs")
    )


def _same(r, bound: tuple[int, str | None]):
    number, code = bound
    hit = r["seq_num"] == number
    return hit if code is None else hit & (r["insert_code"] == code)


def selection_intervals(residues: DataFrame, spec: str, strict: bool = True) -> DataFrame:
    """Closed position intervals a selection stands for: (structure_id, term, first_pos, last_pos).

    Every visited chain contributes one interval per term.  The first residue is the first one that
    fits; the last is searched from there on, and without an insert code it is the last residue of its
    number.  With ``strict`` a visited chain that lacks an end is an error, else it is skipped.
    """
    whole = W.partitionBy("structure_id")
    df = _chain_runs(residues)
    found = []
    for at, term in enumerate(parse_selection(spec)):
        df, interval = _term_interval(df, term, at, whole, strict)
        found.append(interval)
    # one pass over the chain runs serves all terms
    rows = df.select("structure_id", F.explode(F.array(*found)).alias("t")).select("structure_id", "t.*")
    return rows.filter("visited and first_pos is not null and last_pos is not null").drop("visited")


def _term_interval(df: DataFrame, term: Term, at: int, whole, strict: bool):
    """Add the working columns of one term and describe its interval in every chain run."""
    name = lambda c: f"_{c}{at}"
    col = lambda c: F.col(name(c))
    run, chain = F.col("run"), F.col("chain_id")
    begin = F.min(run if term.first_chain is None else F.when(chain == term.first_chain, run)).over(whole)
    if strict and term.first_chain is not None:
        absent = F.raise_error(F.lit(f"chain {term.first_chain} not found")).cast("bigint")
        begin = F.coalesce(begin, absent)
    # an open end means the chain of the last residue of the structure
    last_chain = F.max_by(chain, run).over(whole) if term.last_chain is None else F.lit(term.last_chain)
    df = df.withColumns({name("begin"): begin, name("chain"): last_chain})
    ends = (run >= col("begin")) & (chain == col("chain"))
    df = df.withColumn(name("stop"), F.min(F.when(ends, run)).over(whole))
    visited = (run >= col("begin")) & (col("stop").isNull() | (run <= col("stop")))
    head = F.col("rs") if term.first is None else F.filter("rs", lambda r: _same(r, term.first))
    df = df.withColumn(name("first"), F.try_element_at(head, F.lit(1))["pos"])
    tail = F.filter("rs", lambda r: r["pos"] >= col("first"))
    if term.last is None:
        last = F.try_element_at(tail, F.lit(-1))["pos"]
    else:
        number, code = term.last
        same_number = F.filter(tail, lambda r: r["seq_num"] == number)
        df = df.withColumn(name("at"), F.try_element_at(same_number, F.lit(1))["pos"])
        df = df.withColumn(name("after"), F.filter("rs", lambda r: r["pos"] >= col("at")))
        others = F.filter(name("after"), lambda r: r["seq_num"] != number)
        df = df.withColumn(name("end"), F.try_element_at(others, F.lit(1))["pos"])
        block = F.filter(name("after"), lambda r: col("end").isNull() | (r["pos"] < col("end")))
        if code is None:
            last = F.try_element_at(block, F.lit(-1))["pos"]
        else:
            last = F.try_element_at(F.filter(block, lambda r: r["insert_code"] == code), F.lit(1))["pos"]
    first = col("first")
    if strict:
        message = F.concat(F.lit("selected residue not found in chain "), chain)
        missing = F.when(visited, F.raise_error(message).cast("int"))
        first, last = F.coalesce(first, missing), F.coalesce(last, missing)
    return df, F.struct(
        F.lit(at).alias("term"), first.alias("first_pos"), last.alias("last_pos"),
        F.coalesce(visited, F.lit(False)).alias("visited"),
    )


# The same term as a pattern of the SQL engine; groups as in parse_selection.
_TERM_SQL = r"^(?:(?:(\*)|(-?\d+)([^\s.,\-\d*])?)(?:-(?:(\*)|(-?\d+)([^\s.,\-\d*])?))?)?(?:\.(?:(.)(?:-(.))?)?)?$"


def selection_terms(selections: DataFrame) -> DataFrame:
    """Terms of selection texts given as data: (structure_id, term, readable, bounds) from (structure_id, spec).

    Bounds are first_no, first_code, last_no, last_code, first_chain and last_chain, null where open.  A null text selects
    everything, as an empty one does.
    """
    texts = F.transform(F.split(F.coalesce("spec", F.lit("")), ","), lambda t: F.trim(t))
    rows = selections.select("structure_id", F.posexplode(texts).alias("term", "_text"))
    group = lambda k: F.nullif(F.regexp_extract("_text", _TERM_SQL, k), F.lit(""))
    names = ("star1", "no1", "code1", "star2", "no2", "code2", "chain1", "chain2")
    rows = rows.withColumns({f"_{n}": group(k) for k, n in enumerate(names, 1)})
    c = lambda n: F.col(f"_{n}")
    number = lambda n: F.expr(f"try_cast(_{n} as int)")
    two_ends = c("star2").isNotNull() | c("no2").isNotNull()
    open_chain = c("chain1").isNull() | (c("chain1") == "*")
    last_chain = F.when((c("chain2") == "*") | (c("chain2").isNull() & open_chain), None).otherwise(F.coalesce("_chain2", "_chain1"))
    fits = F.col("_text").rlike(_TERM_SQL) & (c("no1").isNull() == number("no1").isNull()) & (c("no2").isNull() == number("no2").isNull())
    return rows.select(
        "structure_id", "term", fits.alias("readable"), number("no1").alias("first_no"), c("code1").alias("first_code"),
        F.when(two_ends, number("no2")).otherwise(number("no1")).alias("last_no"),
        F.when(two_ends, c("code2")).otherwise(c("code1")).alias("last_code"),
        F.when(~open_chain, c("chain1")).alias("first_chain"), last_chain.alias("last_chain"))


def selection_outcome(residues: DataFrame, selections: DataFrame) -> DataFrame:
    """What selection texts given as data stand for: (structure_id, term, first_pos, last_pos, error).

    ``selections`` (structure_id, spec) has one text per structure; structures without a row are not selected from.  A row
    is a closed interval of one visited chain, or an error instead of it: "term", "chain" or "residue" for a term that
    cannot be read, a chain that is not there and a chain that lacks an end.  The rules are those of selection_intervals.
    """
    terms = selection_terms(selections)
    runs = _chain_runs(residues)
    # as many rows as a structure has chains times the terms of its text
    df = runs.join(terms.filter("readable"), "structure_id")
    whole = W.partitionBy("structure_id", "term")
    run, chain = F.col("run"), F.col("chain_id")
    df = df.withColumns({
        "_begin": F.min(F.when(F.col("first_chain").isNull() | (chain == F.col("first_chain")), run)).over(whole),
        "_chain": F.coalesce(F.col("last_chain"), F.max_by(chain, run).over(whole)), "_lowest": F.min(run).over(whole),
    })
    ends = (run >= F.col("_begin")) & (chain == F.col("_chain"))
    df = df.withColumn("_stop", F.min(F.when(ends, run)).over(whole))
    visited = (run >= F.col("_begin")) & (F.col("_stop").isNull() | (run <= F.col("_stop")))
    lost = F.col("_begin").isNull() & (run == F.col("_lowest"))  # one row tells that the chain is not there
    df = df.filter(visited | lost)
    fits = lambda r, end: (r["seq_num"] == F.col(f"{end}_no")) & (
        F.col(f"{end}_code").isNull() | (r["insert_code"] == F.col(f"{end}_code")))
    head = F.filter("rs", lambda r: F.col("first_no").isNull() | fits(r, "first"))
    df = df.withColumn("first_pos", F.try_element_at(head, F.lit(1))["pos"])
    tail = F.filter("rs", lambda r: r["pos"] >= F.col("first_pos"))
    df = df.withColumn("_tail", F.coalesce(tail, F.expr("filter(rs, r -> false)")))
    numbered = F.filter("_tail", lambda r: r["seq_num"] == F.col("last_no"))
    df = df.withColumn("_at", F.try_element_at(numbered, F.lit(1))["pos"])
    beyond = F.filter("_tail", lambda r: (r["pos"] >= F.col("_at")) & (r["seq_num"] != F.col("last_no")))
    df = df.withColumn("_end", F.try_element_at(beyond, F.lit(1))["pos"])
    block = F.filter("_tail", lambda r: (r["pos"] >= F.col("_at")) & (F.col("_end").isNull() | (r["pos"] < F.col("_end"))))
    coded = F.filter(block, lambda r: r["insert_code"] == F.col("last_code"))
    last = F.when(F.col("last_no").isNull(), F.try_element_at("_tail", F.lit(-1))["pos"]).when(
        F.col("last_code").isNull(), F.try_element_at(block, F.lit(-1))["pos"]).otherwise(F.try_element_at(coded, F.lit(1))["pos"])
    df = df.withColumn("last_pos", last)
    short = F.col("first_pos").isNull() | F.col("last_pos").isNull()
    error = F.when(F.col("_begin").isNull(), "chain").when(short, "residue")
    out = df.withColumn("error", error)
    pos = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    out = out.select("structure_id", "term", pos("first_pos"), pos("last_pos"), "error")
    none = F.lit(None).cast("int")
    unread = terms.filter("not readable").select(
        "structure_id", "term", none.alias("first_pos"), none.alias("last_pos"), F.lit("term").alias("error"))
    return out.unionByName(unread)


def select_by_text(residues: DataFrame, selections: DataFrame) -> DataFrame:
    """Residues that each structure's own text selects, positions renumbered; structures with an error are left out."""
    found = selection_outcome(residues, selections)
    bad = found.filter("error is not null").select("structure_id").distinct()
    chosen = clip(residues, found.filter("error is null").select("structure_id", "first_pos", "last_pos"))
    return renumbered(chosen.join(bad, "structure_id", "left_anti"))


def clip(residues: DataFrame, intervals: DataFrame) -> DataFrame:
    """Residues inside at least one interval, by position in the structure (not renumbered)."""
    bounds = intervals.select(F.col("structure_id").alias("_s"), "first_pos", "last_pos")
    inside = (F.col("_s") == F.col("structure_id")) & F.col("pos").between(F.col("first_pos"), F.col("last_pos"))
    return residues.join(bounds, inside, "left_semi")


def select_residues(residues: DataFrame, spec: str, strict: bool = True) -> DataFrame:
    """The selected residues, positions renumbered."""
    return renumbered(clip(residues, selection_intervals(residues, spec, strict)))


def invalid_intervals(intervals: DataFrame, residues: DataFrame) -> DataFrame:
    """Intervals (first_* and last_* ids) with an end that is no residue of the structure."""
    out = []
    for end in ("first", "last"):
        ids = residues.select("structure_id", *[F.col(c).alias(f"{end}_{c}") for c in RES_ID[1:]])
        on = ["structure_id", *[f"{end}_{c}" for c in RES_ID[1:]]]
        out.append(intervals.join(ids, on, "left_anti").select(*intervals.columns))
    return out[0].unionByName(out[1]).distinct()


def interval_positions(intervals: DataFrame, residues: DataFrame) -> DataFrame:
    """Add first_pos and last_pos (NULL where the end does not exist) to intervals given by ids."""
    out = intervals
    for end in ("first", "last"):
        ids = residues.select(
            "structure_id", *[F.col(c).alias(f"{end}_{c}") for c in RES_ID[1:]], F.col("pos").alias(f"{end}_pos")
        )
        out = out.join(ids, ["structure_id", *[f"{end}_{c}" for c in RES_ID[1:]]], "left")
    return out.select(*intervals.columns, "first_pos", "last_pos")


def extend_intervals(intervals: DataFrame, length: int) -> DataFrame:
    """Widen intervals shorter than ``length``; needs ``n``, the residues of the structure.

    Both sides grow by half the deficit, rounded up; what would stick out at one end of the chain is
    added at the other, and if both ends stick out the interval is the whole chain.
    """
    first, last, n = F.col("first_pos"), F.col("last_pos"), F.col("n")
    deficit = length - (last - first + 1)
    pad = F.ceil(deficit / 2).cast("int")
    over_left = F.greatest(F.lit(0), pad - first)
    over_right = F.greatest(F.lit(0), pad - (n - 1 - last))
    new_first = F.greatest(F.lit(0), F.greatest(F.lit(0), first - pad) - over_right)
    new_last = F.least(n - 1, F.least(n - 1, last + pad) + over_left)
    short = deficit > 0
    both = (over_left > 0) & (over_right > 0)
    return intervals.withColumns({
        "first_pos": F.when(short & both, 0).when(short, new_first).otherwise(first),
        "last_pos": F.when(short & both, n - 1).when(short, new_last).otherwise(last),
        "extended": short,
    })


def sse_intervals(sse: DataFrame, residues: DataFrame, length: int, strict: bool = True) -> DataFrame:
    """Helix and strand intervals inside the selected residues, widened to ``length``.

    Both ends selected: kept; none: dropped; one: an error, or dropped when not ``strict``.
    """
    placed = interval_positions(sse.filter(F.col("kind").isin("HELIX", "SHEET")), residues)
    inside = F.col("first_pos").isNotNull() & F.col("last_pos").isNotNull()
    if strict:
        half = F.col("first_pos").isNull() != F.col("last_pos").isNull()
        message = F.concat(F.lit("interval only partly selected in "), F.col("structure_id").cast("string"))
        # one condition, so that no part of it can drop the row before the error is seen
        inside = F.when(half, F.raise_error(message).cast("boolean")).otherwise(inside)
    kept = placed.filter(inside)
    sizes = residues.groupBy("structure_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return extend_intervals(kept.join(sizes, "structure_id"), length).select(
        "structure_id", "kind", "first_pos", "last_pos", "extended"
    )


def sse_interval_pairs(sse: DataFrame, pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """All pairs of equal-kind intervals of the two structures of a pair, as rectangles.

    Intervals of a structure are gathered first, so the join is one row per pair and side, and the
    number of rectangles of a pair is known before it expands; more than ``limit``, if given, is an error.
    """
    from strandfold.functions.skew import spread_join

    packed = sse.groupBy("structure_id").agg(
        F.array_sort(F.collect_list(F.struct("kind", "first_pos", "last_pos"))).alias("ss")
    )
    hot = hot_structures(pairs)
    out = pairs.select("pair_id", "a", "b")
    for side in "ab":
        mine = packed.select(F.col("structure_id").alias(side), F.col("ss").alias(f"s{side}"))
        out = spread_join(out, mine, side, ["pair_id"], hot)
    if limit is not None:
        of = lambda side, kind: F.size(F.filter(f"s{side}", lambda s: s["kind"] == kind)).cast("long")
        boxes = of("a", "HELIX") * of("b", "HELIX") + of("a", "SHEET") * of("b", "SHEET")
        message = F.concat(F.lit("too many interval pairs in pair "), F.col("pair_id").cast("string"))
        out = out.withColumn("sa", F.when(boxes > limit, F.raise_error(message).cast(
            "array<struct<kind:string,first_pos:int,last_pos:int>>")).otherwise(F.col("sa")))
    return (
        out.select("pair_id", "sb", F.explode("sa").alias("s"))
        .select("pair_id", "s", F.explode(F.filter("sb", lambda t: t["kind"] == F.col("s.kind"))).alias("t"))
        .select(
            "pair_id", F.col("s.kind").alias("kind"),
            F.col("s.first_pos").alias("a_first"), F.col("s.last_pos").alias("a_last"),
            F.col("t.first_pos").alias("b_first"), F.col("t.last_pos").alias("b_last"),
        )
    )


def select_structure(lines: DataFrame, selected: DataFrame) -> DataFrame:
    """Filter structure lines by selected residues (structure_id, chain_id, seq_num, insert_code).

    Atom lines stay if their residue is selected, interval lines if both ends are, others always.
    """
    ids = selected.select(*RES_ID).distinct().withColumn("_found", F.lit(1))
    kind = record_kind(F.col("line"))
    key = lambda parts: F.struct(*[value.alias(name) for name, value in parts.items()])
    # the residues a line depends on: one for atoms, two for intervals, none for all others
    needs = (
        F.when(kind.isin("ATOM", "HETATM", "ANISOU"), F.array(key(atom_residue(F.col("line")))))
        .when(kind.isin(*INTERVAL_FIELDS), F.array(*[key(interval_end(F.col("line"), kind, end)) for end in (0, 1)]))
    )
    asked = lines.select("structure_id", "line_no", "line", F.explode_outer(needs).alias("r"))
    asked = asked.select("structure_id", "line_no", "line", "r.*", F.col("r").isNotNull().cast("int").alias("_asked"))
    return (
        asked.join(ids, RES_ID, "left").groupBy("structure_id", "line_no")
        .agg(F.first("line").alias("line"), F.sum("_asked").alias("_asked"), F.count("_found").alias("_found"))
        .filter("_asked = _found").select("structure_id", "line_no", "line")
    )


def reindex_matches(matches: DataFrame, owners: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Match positions of ``old`` residues as positions of ``new`` residues with the same ids.

    ``owners`` is (pair_id, a, b); matches of residues absent from ``new`` are left out.
    """
    both = old.select(*RES_ID, F.col("pos").alias("_old")).join(
        new.select(*RES_ID, F.col("pos").alias("_new")), RES_ID
    ).select("structure_id", "_old", "_new")
    out = matches.join(owners, "pair_id")
    for side, index in (("a", "i"), ("b", "j")):
        step = both.select(
            F.col("structure_id").alias(side), F.col("_old").alias(index), F.col("_new").alias(f"_{index}")
        )
        out = out.join(step, [side, index])
    return out.select("pair_id", "k", F.col("_i").alias("i"), F.col("_j").alias("j"))


def is_monotonic(matches: DataFrame, key: str) -> DataFrame:
    """Whether both positions increase strictly with k, per alignment."""
    order = W.partitionBy(key).orderBy("k")
    steps = matches.select(
        key, (F.col("i") > F.lag("i").over(order)).alias("up_i"), (F.col("j") > F.lag("j").over(order)).alias("up_j")
    )
    ok = F.coalesce(F.col("up_i"), F.lit(True)) & F.coalesce(F.col("up_j"), F.lit(True))
    return steps.groupBy(key).agg(F.bool_and(ok).alias("monotonic"))


def same_alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Whether two alignments have the same matches in the same order, per case."""
    side = lambda df, l: df.select(key, "k", "i", "j", F.lit(l).alias("_w"))
    tallied = side(left, 1).unionByName(side(right, -1)).groupBy(key, "k", "i", "j").agg(F.sum("_w").alias("_w"))
    return tallied.groupBy(key).agg((F.max(F.abs("_w")) == 0).alias("same"))

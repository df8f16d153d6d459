"""Secret scans: fixed patterns plus character Markov models of random strings against ordinary words.

Two first-order chains over ASCII characters, one of random strings and one of ordinary identifiers, are counted from
labelled samples; a token is a secret if its log-likelihood ratio per character exceeds a threshold.  Everything is
DataFrame expressions; only the two tables of character pairs, of fixed size, pass through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandfold.llm.common import materialise, register, set_aside, table, top_ids, without

# Fixed patterns of the base scan.  The runs of access and hex carry their least length, which finds the same matches as
# the whole run filtered afterwards; an assignment that is too short must still be consumed, so it is filtered.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
VALUE = r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z_-]{6,}"
# Character pairs are numbered from "+" (43) to "z" (122).
FIRST, WIDTH = 43, 80
SMOOTH = 0.5
THRESHOLD = 0.6
SAMPLE_TOKENS = 20_000
SAMPLE_DOCS = 1_000
BLOCK = 256

SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


def running(numbers: Column) -> Column:
    """Sums of all earlier elements of an array of longs, block by block so that the work stays near linear."""
    zero = F.lit(0).cast("long")

    def ahead(values: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(values, begin, lambda s, x: F.struct(
            (s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]

    count = F.ceil(F.size(numbers) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, x: s + x))
    return F.flatten(F.zip_with(blocks, ahead(sums, zero), ahead))


def places(gaps: Column, found: Column) -> Column:
    """Matches as structs (start, end, value) in code points, end exclusive, from the text split at its matches."""
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: (F.length(g) + F.length(v)).cast("long"))
    starts = F.zip_with(running(steps), F.slice(gaps, 1, F.size(found)), lambda s, g: s + F.length(g))
    return F.when(F.size(found) > 0, F.zip_with(starts, found, lambda s, v: F.struct(
        s.alias("start"), (s + F.length(v)).alias("end"), v.alias("value")))).otherwise(F.array().cast(SPANS))


def long_enough(match: Column) -> Column:
    return F.length(F.regexp_extract(match, VALUE, 1)) >= LEAST_VALUE


def found_in(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """``df`` plus all matches and, where there are any, the gaps between them."""
    df = df.withColumn(f"_m_{name}", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return df.withColumn(f"_g_{name}", F.when(F.size(f"_m_{name}") > 0, F.split(text, pattern, -1)))


def base_scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns plus assign, access, hex and candidate tokens, each an array of (start, end, value).

    Candidates are runs of at least 20 token characters that overlap no span of the other kinds.
    """
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("text", F.lit("")).alias("_text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        df = found_in(df, "_text", pattern, name)
    spaces = F.transform("_m_assign", lambda v: F.when(long_enough(v), F.repeat(F.lit(" "), F.length(v))).otherwise(v))
    plain = F.array_join(F.zip_with(
        "_g_assign", spaces, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    df = df.withColumn("_rest", F.when(F.size("_m_assign") > 0, plain).otherwise(F.col("_text")))
    df = found_in(df, "_rest", TOKEN, "token")
    spans = {n: places(F.col(f"_g_{n}"), F.col(f"_m_{n}")) for n in ("assign", "access", "hex", "token")}
    spans["assign"] = F.filter(spans["assign"], lambda s: long_enough(s["value"]))
    spans["token"] = F.filter(spans["token"], lambda s: ~(s["value"].rlike(HEX) | s["value"].rlike(ACCESS)))
    return df.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(f"_{n}") for n, c in spans.items()])


def labelled_tokens(scanned: DataFrame, docs: DataFrame) -> DataFrame:
    """(token, random): labels by the base scan.

    Random strings are the values of its spans, ordinary ones the words of a hashed sample of ``SAMPLE_DOCS`` documents;
    of either at most ``SAMPLE_TOKENS`` distinct ones, the first by hash.
    """
    values = F.concat(
        F.transform("_assign", lambda s: F.regexp_extract(s["value"], VALUE, 1)),
        F.transform("_access", lambda s: s["value"]), F.transform("_hex", lambda s: s["value"]))
    random = top_ids(scanned.select(F.explode(values).alias("token")), SAMPLE_TOKENS, "token")
    chosen = top_ids(docs.select("doc_id").filter("doc_id is not null"), SAMPLE_DOCS, "doc_id")
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    ordinary = some.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("token"))
    ordinary = top_ids(ordinary, SAMPLE_TOKENS, "token")
    return random.withColumn("random", F.lit(True)).unionByName(ordinary.withColumn("random", F.lit(False)))


def pairs(token: Column) -> Column:
    """Numbers of the consecutive character pairs of a token, from 0; other characters count as the nearest one."""
    codes = F.transform(F.split(token, ""), lambda c: F.least(F.greatest(F.ascii(c) - FIRST, F.lit(0)), F.lit(WIDTH - 1)))
    return F.zip_with(codes, F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: a * WIDTH + b)


def train(samples: DataFrame) -> list[float] | None:
    """Log-likelihood ratio of every character pair (random over ordinary) from (token, random), or None.

    None if either label is missing: then no token can be told apart.  Null tokens are left out.
    """
    counted = samples.filter("token is not null").select(
        "random", F.explode(F.filter(pairs(F.col("token")), lambda p: p.isNotNull())).alias("pair"))
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in counted.groupBy("random", "pair").count().collect():
        counts[r["random"]][r["pair"]] = r["count"]
    if not counts[True] or not counts[False]:
        return None

    def logs(found: dict[int, int]) -> list[float]:
        out = []
        for a in range(WIDTH):
            row = [found.get(a * WIDTH + b, 0) + SMOOTH for b in range(WIDTH)]
            total = sum(row)
            out += [math.log(n / total) for n in row]
        return out

    return [round(x - y, 4) for x, y in zip(logs(counts[True]), logs(counts[False]))]


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per character pair of a token."""
    logs = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    steps = F.filter(pairs(token), lambda p: p.isNotNull())
    total = F.aggregate(steps, F.lit(0.0), lambda s, p: s + F.element_at(logs, p + 1))
    return F.when(F.size(steps) > 0, total / F.size(steps)).otherwise(0.0)


@set_aside("doc_id", "text", "n_chars")
def secrets(docs: DataFrame, samples: DataFrame | None = None, threshold: float = THRESHOLD,
            keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) plus ``secrets``: spans (start, end, kind, value) by start, then kind.

    Kinds are assign, access, hex and, by the Markov models, random.  ``samples`` (token, random) train the models; without
    it, the base scan labels its own.  Null texts count as empty and have no span.  The scan is written once, as
    training and scoring both read it.  Clashing columns of ``docs`` are replaced.
    """
    docs = without(docs, "secrets")
    keep = docs.columns if keep is None else keep
    scanned = materialise(base_scan(docs, keep), "secret-scan")
    model = train(labelled_tokens(scanned, docs) if samples is None else samples)
    spans = [(k, F.col(f"_{name}")) for k, name in enumerate(KINDS[:3])]
    if model is not None:
        spans.append((3, F.filter("_token", lambda s: ratio(s["value"], model) > threshold)))

    def with_order(column: Column, k: int) -> Column:
        return F.transform(column, lambda s: F.struct(
            s["start"].alias("start"), F.lit(k).alias("order"), s["end"].alias("end"), s["value"].alias("value")))

    numbered = [with_order(c, k) for k, c in spans]
    names = F.array(*map(F.lit, KINDS))
    ordered = F.transform(F.array_sort(F.concat(*numbered)), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["order"] + 1).alias("kind"),
        s["value"].alias("value")))
    return scanned.select(*[F.col(f"`{c}`") for c in keep], ordered.alias("secrets"))


@set_aside("doc_id", "text", "n_chars")
def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every secret replaced by ``mark`` and n_chars, if there, set to the new length.

    Overlapping spans become one.  Texts without a span, null included, stay as they are.
    """
    found = secrets(docs, **options)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    length = F.length("text")

    def add(state, span):
        piece = F.substring(F.col("text"), (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        more = F.concat(state["out"], F.when(span["start"] >= state["at"], F.array(piece, F.lit(mark))).otherwise(
            F.array().cast("array<string>")))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), more.alias("out"))

    def end(state):
        rest = F.substring(F.col("text"), (state["at"] + 1).cast("int"), length)
        return F.concat(F.array_join(state["out"], ""), rest)

    text = F.when(F.size("secrets") > 0, F.aggregate("secrets", begin, add, end)).otherwise(F.col("text"))
    columns = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    out = found.select(*columns, (F.size("secrets") > 0).alias("_changed"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_changed"), F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.drop("_changed")


@register("op4_secret_scan")
def op4(spark, sf_dir):
    """Counts, digest of the base spans and all spans of secrets of every document."""
    found = secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", shown), ",").alias("spans"),
    )

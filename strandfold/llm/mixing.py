"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

A source's target over its size is the number of copies a document gets on average.  The whole part is certain; for
the rest each document has an inclusion probability, and documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)).  The first in that order whose words come nearest to what is left are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandfold.llm.common import materialise, register, set_aside, table, without

WEIGHTS = (3.0, 1.0, 2.0)
SLICES = 1 << 12
GRAIN = 1000


def words(text: Column) -> Column:
    """Number of runs of anything but space and U+0009..U+000D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Weights repeat over the sources by code point, null last.  The words asked for are ``total`` times all words; no
    target exceeds ``cap`` times its source's words, and what is over is shared again by weight.  The sources at
    their cap are those with the least cap per weight, so running sums in that order give the final shares.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % n + 1).cast("int"))
    weighed = sources.select("source", "source_size", weight.alias("w"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = weighed.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    running = capped.select(
        "*",
        (total * F.sum("source_size").over(every)).alias("all"),
        F.sum("w").over(every).alias("all_w"),
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("most_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"),
    )
    level = (F.col("all") - F.col("most_before")) / (F.col("all_w") - F.col("w_before"))
    leveled = running.withColumn("level", level).withColumn("full", F.col("level") >= F.col("ratio"))
    share = F.min(F.when(~F.col("full"), F.struct("ratio", "level"))).over(every)["level"]
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * share)
    return leveled.select("source", "source_size", target.cast("double").alias("target"))


def unit(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts: the same in every run and on every machine."""
    head = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / float(1 << 48)


@set_aside("doc_id", "source", "text")
def sample(docs: DataFrame, seed: int = 7, keep: list[str] | None = None, **shares) -> DataFrame:
    """``docs`` (or its columns ``keep``) plus size, source_size, target, copies and taken = copies * size.

    A source of target t and s words gives every document floor(t / s) certain copies.  With r = t / s - floor(t / s),
    a document's inclusion probability is r * (1 + (1 - r) * x), x in [-1, 1] rising with the logarithm of its
    size and averaging 0 over the words of the source, so that the words expected are r * s.  Ranks are cut where the
    running words come nearest to the words left.  Texts without words (null, empty) have size 0 and only certain copies;
    a null source is a source of its own.  Rows with equal id and text rank together and any of them may be taken.

    Running words are summed over ``SLICES`` slices of the random number first and inside the slice of the cut only,
    so that a source with most of the rows is never one task.  Clashing columns of ``docs`` are replaced.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    docs = without(docs, *made)
    keep = docs.columns if keep is None else keep
    names = ["doc_id", "source", "text_hash", "size"]
    rows = docs.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("text_hash"), words(F.col("text")).alias("size"))
    rows = materialise(rows, "mix-sizes")
    grain = F.floor(GRAIN * F.log(F.col("size") + 1.0)).cast("long")
    per = rows.withColumn("g", grain).groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("g") * F.col("size")).alias("gs"),
        F.min("g").alias("g0"), F.max("g").alias("g1"))
    per = materialise(
        targets(per.select("source", "source_size"), **shares).withColumnRenamed("source", "s")
        .join(per.drop("source_size"), F.col("s").eqNullSafe(F.col("source"))).drop("s"), "mix-sources")

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mean = F.try_divide(F.col("gs"), F.col("source_size"))  # null for a source without words
    reach = F.greatest(F.col("g1") - mean, mean - F.col("g0"))
    lean = F.when(reach > 0, (F.col("g") - mean) / reach).otherwise(0.0)
    u = unit(F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text_hash"))
    per = per.withColumnRenamed("source", "s")
    ranked = rows.join(per, F.col("s").eqNullSafe(F.col("source"))).drop("s").withColumn("g", grain)
    ranked = ranked.withColumn("whole", F.floor(ratio)).withColumn("r", ratio - F.floor(ratio))
    ranked = ranked.withColumn("p", F.col("r") * (1 + (1 - F.col("r")) * lean)).withColumn("u", u)
    odds = F.when((F.col("p") > 0) & (F.col("size") > 0), F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p"))
    ranked = ranked.withColumn("q", odds).withColumn("slice", F.floor(SLICES * F.col("q") / (1 + F.col("q"))))
    ranked = materialise(
        ranked.select(*names, "source_size", "target", "whole", "r", "q", "slice"), "mix-ranks")

    sums = ranked.filter("q is not null").groupBy("source", "slice", "source_size", "r").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    slices = slices.withColumn("rest", F.col("r") * F.col("source_size")).select(
        F.col("source").alias("_source"), F.col("slice").alias("_slice"), "before", "words", "rest")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice"))
    placed = ranked.join(slices, same, "left").drop("_source", "_slice")
    cut = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    inside = placed.filter(cut)
    order = Window.partitionBy("source", "slice").orderBy("q", "doc_id", "text_hash")
    done = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = inside.withColumn("done", F.col("before") + done)
    nearer = F.col("rest") - F.col("done") >= F.col("done") + F.col("size") - F.col("rest")
    inside = inside.withColumn("more", (F.col("done") < F.col("rest")) & nearer).drop("done")
    outside = placed.filter(~F.coalesce(cut, F.lit(False))).withColumn(
        "more", F.coalesce(F.col("before") < F.col("rest"), F.lit(False)))
    copies = (F.col("whole") + F.col("more").cast("int")).cast("long")
    chosen = inside.unionByName(outside).withColumn("copies", copies)
    chosen = chosen.withColumn("taken", F.col("copies") * F.col("size"))
    if keep == ["doc_id"]:
        return chosen.select("doc_id", *made)
    facts = chosen.select("doc_id", "source", "text_hash", *made)
    number = Window.partitionBy("doc_id", "source", "text_hash")
    facts = facts.withColumn("_n", F.row_number().over(number.orderBy("copies")))
    facts = facts.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("text_hash").alias("_t"), "_n", *made)
    rows = docs.withColumn("_h", F.md5(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("_m", F.row_number().over(Window.partitionBy("doc_id", "source", "_h").orderBy(F.lit(0))))
    match = (F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s"))
             & (F.col("_h") == F.col("_t")) & (F.col("_m") == F.col("_n")))
    return rows.join(facts, match).select(*[F.col(f"`{c}`") for c in keep], *made)


@register("op5_mix_sources")
def op5(spark, sf_dir):
    """How many words of each document the mix takes."""
    mixed = sample(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")

"""SimHash fingerprints of word shingles, linked by Hamming distance with pigeonring filtering.

The 64 bits form a ring of equal segments.  If two fingerprints differ in at most d bits, the ring has a segment from
which every chain of consecutive segments keeps to its proportional budget: the first l segments differ in at most
floor(l * d / segments) bits, for every l.  The budget of the first ceil(segments / d) - 1 segments is zero, so these
are an exact join key; chains over their budget are dropped before the full Hamming check.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandfold.llm.common import append_arrow, components, materialise, register, set_aside, table
from strandfold.llm.paragraphs import mixed, numbers

BITS = 64
BLOCK = 1 << 16
RING = 16  # words of a wide ring


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """SimHash of the text's word shingles as a signed 64-bit number; 0 without words.

    Words are runs of anything but space and U+0009..U+000D after lower-casing A-Z; fewer than ``size`` words form
    one shingle.  A bit is set if it is set in over half of the shingle hashes, repeats counted.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, BLOCK):
        pairs = zip(starts[k : min(n, k + BLOCK)].tolist(), last[k : k + BLOCK].tolist())
        hashes = np.array([digest(line[s:e], seed) for s, e in pairs], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def ring_words(runs: list[np.ndarray], words: int = RING) -> np.ndarray:
    """Wide SimHash of each set of hashes, (sets, words): a bit is set if over half of the distinct hashes, mixed anew for
    every word, have it."""
    factors, shifts = numbers(words, 4), numbers(words, 5)
    out = np.empty((len(runs), words), dtype=np.int64)
    for k, values in enumerate(runs):
        values = np.unique(values)
        ones = np.zeros(words * BITS, dtype=np.int64)
        for at in range(0, len(values), 255):  # sums of 255 bits fit a byte
            hashes = mixed(mixed(values[at : at + 255, None] * factors + shifts))
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.uint8)
        out[k] = np.packbits(2 * ones > len(values), bitorder="little").view("<i8")
    return out


def ring_bits(words: np.ndarray) -> np.ndarray:
    """The bits, one byte each, of rings (sets, words)."""
    return np.unpackbits(np.ascontiguousarray(words, dtype="<i8").view(np.uint8), axis=1, bitorder="little")


def with_fingerprints(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` (or its columns ``keep``) plus ``fp``, the fingerprint of each whole text as a long.

    Null and empty texts have fingerprint 0.  A clashing column ``fp`` is replaced.
    """

    def make(batches):
        for texts in batches:
            yield ([fingerprint(t) for t in texts],)

    return append_arrow(docs, {"fp": "long"}, make, keep, text)


def _turned(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftrightunsigned(fp, by).bitwiseOR(F.shiftleft(fp, BITS - by))


def _low(fp: Column, bits: int) -> Column:
    return fp if bits >= BITS else fp.bitwiseAND(F.lit((1 << bits) - 1))


def budgets(distance: int, segments: int) -> list[tuple[int, int]]:
    """(chain length, allowed bits): for each allowance only the longest chain, which implies the shorter ones."""
    longest = {}
    for length in range(1, segments + 1):
        longest[length * distance // segments] = length
    return [(length, allowed) for allowed, length in longest.items()]


def links(fps: DataFrame, distance: int = 2, segments: int = 16, bucket: int = 64) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints (column ``fp``) that differ in 1 to ``distance`` bits.

    Each fingerprint is filed once per chain start under the zero-budget part of the chain.  Buckets of up to ``bucket``
    fingerprints are joined with themselves.  In larger ones the chain is followed to the end of its one-bit budget: one
    side files that longer chain, the other side it and all its one-bit variants, so that only chains within the
    budget meet, however many fingerprints share the first part; no link is lost.
    """
    width = BITS // segments
    if width * segments != BITS or distance < 1:
        raise ValueError("segments must divide 64 and distance be positive")
    steps = budgets(distance, segments)
    if steps[0][1] != 0:
        raise ValueError("a chain needs a zero budget first: more segments than distance")
    first, longer = steps[0][0] * width, steps[1][0] * width
    fps = fps.select("fp").distinct()
    filed = fps.select(
        "fp",
        F.explode(F.array(*[
            F.struct(F.lit(k).alias("at"), _low(_turned(F.col("fp"), k * width), first).alias("key"))
            for k in range(segments)
        ])).alias("s"),
    ).select("fp", "s.at", "s.key")
    shared = filed.groupBy("at", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    filed = materialise(filed.join(shared, ["at", "key"]), "segments")

    def turned_at(column: str) -> Column:
        turn = F.expr(f"shiftrightunsigned({column}, at * {width}) | shiftleft({column}, {BITS} - at * {width})")
        return F.when(F.col("at") == 0, F.col(column)).otherwise(turn)

    few = filed.filter(F.col("members") <= bucket).select("at", "key", "fp")
    near = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["at", "key"]).filter("a < b")

    many = filed.filter(F.col("members") > bucket).select("at", turned_at("fp").alias("ring"), "fp")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(first, longer)])
    chain = _low(F.col("ring"), longer)
    plain = many.select("at", chain.alias("chain"), F.col("fp").alias("a"))
    varied = many.select("at", "fp", chain.alias("c"), F.explode(flips).alias("flip")).select(
        "at", F.col("c").bitwiseXOR(F.col("flip")).alias("chain"), F.col("fp").alias("b")
    )
    far = plain.join(varied, ["at", "chain"]).filter("a <> b").select(
        "at", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )

    pairs = near.select("at", "a", "b").unionByName(far)
    differ = F.col("a").bitwiseXOR(F.col("b"))
    pairs = pairs.withColumn("x", differ).withColumn("ring", turned_at("x"))
    for length, allowed in steps:
        pairs = pairs.filter(F.bit_count(_low(F.col("ring"), length * width)) <= allowed)
    return pairs.select("a", "b").distinct()


def groups(docs: DataFrame, distance: int = 2, keep: list[str] | None = None) -> DataFrame:
    """(``keep`` columns, fp, text_hash, component_id): component_id is the smallest doc_id reachable by links.

    Documents with equal fingerprints are linked.  Null doc_ids count as larger than all others, so a group made of
    them alone has a null component_id.  Works on distinct fingerprints; copies are only joined back at the end.
    """
    keep = ["doc_id"] if keep is None else keep
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    marked = materialise(with_fingerprints(hashed, [*keep, "text_hash"]), "fingerprints")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    part = components(links(least, distance)).withColumnsRenamed({"node": "fp", "component": "root"})
    rooted = least.join(part, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(ids, "root").select("fp", "component_id"), "fp")


@set_aside("doc_id", "text")
def one_of_each(docs: DataFrame, distance: int = 2) -> DataFrame:
    """The documents less near-duplicates: of each group the row with the smallest doc_id stays.

    If several rows have that id, the one with the smallest text hash stays; of identical rows, one.
    """
    found = groups(docs, distance)
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # A null component_id can stand for several groups, so it is told apart by its fingerprint.
    first = first.withColumn("mark", F.when(F.col("component_id").isNull(), F.col("fp")))
    kept = first.groupBy("component_id", "mark").agg(F.min("text_hash").alias("text_hash"))
    kept = kept.select(F.col("component_id").alias("_id"), F.col("text_hash").alias("_hash"))
    return rows_of(docs, kept, first)


def rows_of(docs: DataFrame, kept: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of ``docs`` with an id and text hash in ``kept`` (_id, _hash), once each.

    ``first`` (doc_id, text_hash) has one row for every row of ``docs`` that may be kept.
    """
    rows = docs.withColumn("_h", F.xxhash64("text"))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left_semi")
    twice = first.groupBy("doc_id", "text_hash").count().filter("count > 1").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    twin = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash"))
    single = rows.join(twice, twin, "left_anti")
    repeated = rows.join(twice, twin, "left_semi").dropDuplicates(["doc_id", "_h"])
    return single.unionByName(repeated).drop("_h")


@register("op7_simhash_pigeonring")
def op7(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

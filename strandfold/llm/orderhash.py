"""Order MinHash fingerprints, with DataFrame expressions only.

The k-mers of a text are runs of ``K`` consecutive words, numbered by occurrence, so that repeats count.  Each numbered
k-mer has one hash, which also deals it to one of ``BINS`` bins (one pass instead of one permutation per bin).  In every
bin the ``PICKS`` numbered k-mers with the least hashes are taken, put back into text order and hashed as a tuple.  A bin
that holds fewer takes the ``PICKS`` least of all k-mers of the text under a permutation of its own, so that short texts
keep their order; that happens to few bins of long texts, so the work per text stays bounded.
Unlike a set signature it changes when the picked k-mers swap places, so it follows the edit distance.

All arrays are of longs that pack hash and position, so that sorting is primitive and the work per text is that of a
sort.  Position fields are wide enough for any text that fits a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandfold.llm.common import register, table, without

K = 2
BIN_BITS = 6
BINS = 1 << BIN_BITS
PICKS = 2
PLACE_BITS = 30
HASH_BITS = 63 - PLACE_BITS
VALUE_BITS = HASH_BITS - BIN_BITS
LONG_BYTES = 48
GRAM_STEPS = (1, 2, 4)
WORD = r"[^\x20\x09-\x0D]+"

BUCKET_BYTES = 4 << 20
MOST_BUCKETS = 20_000


def mask(bits: int) -> Column:
    return F.lit((1 << bits) - 1)


def low(number: Column, bits: int) -> Column:
    return number.bitwiseAND(mask(bits))


def changes(packed: Column, bits: int) -> Column:
    """Indexes (from 0) at which the part above ``bits`` of a sorted array differs from the one before."""
    def starts(k):
        same = F.shiftright(F.get(packed, k), bits) == F.shiftright(F.get(packed, k - 1), bits)
        return (k == 0) | ~F.coalesce(same, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(packed) - 1), starts)


def grams(word: Column) -> Column:
    """Hashes of the runs of 8 characters of ``word``, one from every character on that has 7 more behind it."""
    def joined(step: int):
        def pairs(h: Column) -> Column:
            fewer = F.size(h) - step
            return F.zip_with(F.slice(h, 1, fewer), F.slice(h, 1 + step, fewer), lambda a, b: F.xxhash64(a, b))

        return pairs

    out = F.transform(F.split(word, ""), lambda c: F.xxhash64(c))
    for step in GRAM_STEPS:
        out = F.get(F.transform(F.array(out), joined(step)), F.lit(0))
    return out


def with_kmers(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` plus the sorted array of (hash << PLACE_BITS) | position of the k-mers of ``text``.

    Words are runs of anything but space and U+0009..U+000D; one of more than ``LONG_BYTES`` bytes counts as its runs of 8
    characters, so that text without spaces is compared too.  A text of fewer than K words has one k-mer, of its words,
    and one without words (null, empty) has one of nothing.  Every step is a column of its own, evaluated once.
    """
    df = df.withColumn("_w", F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)))
    cut = F.transform("_w", lambda w: F.when(F.octet_length(w) > LONG_BYTES, grams(w)).otherwise(F.array(F.xxhash64(w))))
    long_words = F.exists("_w", lambda w: F.octet_length(w) > LONG_BYTES)
    hashed = F.when(long_words, F.flatten(cut)).otherwise(F.transform("_w", lambda w: F.xxhash64(w)))
    df = df.withColumn("_h", F.when(F.size("_w") > 0, hashed).otherwise(F.array(F.lit(0).cast("long")))).drop("_w")
    for k in range(1, K):
        fewer = F.size("_h") - 1
        pairs = F.zip_with(F.slice("_h", 1, fewer), F.slice("_h", 2, fewer), lambda a, b: F.xxhash64(a, b))
        df = df.withColumn(f"_h{k}", F.when(fewer > 0, pairs).otherwise(F.col("_h"))).drop("_h").withColumnRenamed(f"_h{k}", "_h")
    packed = F.transform("_h", lambda h, k: F.shiftleft(low(h, HASH_BITS), PLACE_BITS).bitwiseOR(k.cast("long")))
    return df.withColumn(name, F.sort_array(packed)).drop("_h")


def numbered(sorted_kmers: Column, starts: Column) -> Column:
    """Sorted array of bin, value and position of every k-mer with its occurrence number, packed into a long."""
    def pack(kmer: Column, occurrence: Column) -> Column:
        h = F.xxhash64(F.shiftright(kmer, PLACE_BITS), occurrence)
        return F.shiftleft(low(h, HASH_BITS), PLACE_BITS).bitwiseOR(low(kmer, PLACE_BITS))

    def run(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(starts, k + 1), F.size(sorted_kmers))
        return F.transform(F.slice(sorted_kmers, start + 1, stop - start), lambda x, i: pack(x, i))

    once = F.transform(sorted_kmers, lambda x: pack(x, F.lit(0)))
    return F.sort_array(F.when(F.size(starts) == F.size(sorted_kmers), once).otherwise(F.flatten(F.transform(starts, run))))


def with_tokens(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` plus the Order MinHash of ``text`` as an array of ``BINS`` numbers; null counts as empty.

    A number is 1 to 65535, from the tuple of the bin's picked k-mers in text order.
    """
    df = with_kmers(df, text, "_k").withColumn("_s", changes(F.col("_k"), PLACE_BITS))
    df = df.withColumn("_p", numbered(F.col("_k"), F.col("_s"))).drop("_k", "_s")
    df = df.withColumn("_b", changes(F.col("_p"), PLACE_BITS + VALUE_BITS))
    picks, starts = F.col("_p"), F.col("_b")

    def joined(chosen: Column) -> Column:
        by_place = F.sort_array(F.transform(chosen, lambda x: F.shiftleft(low(x, PLACE_BITS), VALUE_BITS).bitwiseOR(
            low(F.shiftright(x, PLACE_BITS), VALUE_BITS))))
        mixed = F.aggregate(by_place, F.lit(0).cast("long"), lambda s, x: F.xxhash64(s, low(x, VALUE_BITS)))
        return (F.pmod(mixed, F.lit(65535)) + 1).cast("int")

    def permuted(number: Column) -> Column:
        def mix(x: Column) -> Column:
            h = F.xxhash64(F.shiftright(x, PLACE_BITS), number)
            return F.shiftleft(low(h, HASH_BITS), PLACE_BITS).bitwiseOR(low(x, PLACE_BITS))

        return F.slice(F.sort_array(F.transform(picks, mix)), 1, PICKS)

    def of_bin(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(starts, k + 1), F.size(picks))
        own = F.slice(picks, start + 1, PICKS)
        return joined(F.when(stop - start >= PICKS, own).otherwise(permuted(bin_at(start))))

    def between(first: Column, last: Column) -> Column:
        filled = F.transform(F.sequence(first, last), lambda number: joined(permuted(number)))
        return F.when(first <= last, filled).otherwise(F.array().cast("array<int>"))

    def bin_at(start: Column) -> Column:
        return F.coalesce(F.shiftright(F.get(picks, start), PLACE_BITS + VALUE_BITS).cast("int"), F.lit(-1))

    def with_gap(start: Column, k: Column) -> Column:
        return F.concat(between(bin_at(F.get(starts, k - 1)) + 1, bin_at(start) - 1), F.array(of_bin(start, k)))

    rest = between(bin_at(F.size(picks) - 1) + 1, F.lit(BINS - 1))
    return df.withColumn(name, F.concat(F.flatten(F.transform(starts, with_gap)), rest)).drop("_p", "_b")


def shown(numbers: Column) -> Column:
    """The fingerprint as text: four hexadecimal digits per bin."""
    return F.array_join(F.transform(numbers, lambda n: F.lower(F.lpad(F.hex(n), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins used by either of two fingerprints in which both agree."""
    same = F.zip_with(a, b, lambda x, y: (x == y) & (x > 0))
    used = F.zip_with(a, b, lambda x, y: (x > 0) | (y > 0))
    count = lambda flags: F.size(F.filter(flags, lambda f: f))
    return count(same) / count(used)


def fingerprints(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` (or its columns ``keep``) plus ``fingerprint``; equal texts have equal fingerprints.

    Null and empty texts share one fingerprint.  A clashing column is replaced.
    """
    docs = without(docs, "fingerprint")
    keep = docs.columns if keep is None else keep
    made = with_tokens(docs, F.col(text), "_tokens").withColumn("fingerprint", shown(F.col("_tokens")))
    return made.select(*[F.col(f"`{c}`") for c in keep], "fingerprint")


def bucket_of(key: Column, borders: list) -> Column:
    """How many of the sorted ``borders`` are below ``key``, by two short steps; null keys get -1."""
    if not borders:
        return F.when(key.isNull(), -1).otherwise(0)
    step = math.isqrt(len(borders)) + 1
    fine = [borders[k : k + step] for k in range(0, len(borders), step)]

    def literal(values: list) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    rows = F.transform(F.split(F.lit(";".join(",".join(map(str, f)) for f in fine)), ";"), lambda s: F.split(s, ",").cast("array<bigint>"))
    coarse = F.size(F.filter(literal([f[0] for f in fine]), lambda b: b < key))
    inner = F.when(coarse > 0, (coarse - 1) * step + F.size(F.filter(F.get(rows, coarse - 1), lambda b: b < key))).otherwise(0)
    return F.when(key.isNull(), -1).otherwise(inner)


def with_next(rows: DataFrame, key: str, order: str, size: Column, carried: list[str], prepare=lambda df: df) -> DataFrame:
    """``prepare(rows)`` plus next_<c> for each of ``carried``: the values of the next row by descending ``key``.

    After the last row comes the first.  Equal keys follow each other by descending ``order``; null keys come last.  Rows
    are dealt to ranges of the key of about ``BUCKET_BYTES`` each (at most ``MOST_BUCKETS``, whose borders and first keys
    are all that reaches the driver).  Each range gets the first row of the next one as a guest at its end.
    """
    session = rows.sparkSession
    total = int(rows.agg(F.sum(size)).first()[0] or 0)
    count = min(MOST_BUCKETS, max(1, -(-total // BUCKET_BYTES)))
    borders = []
    if count > 1:
        points = [k / count for k in range(1, count)]
        borders = sorted(set(rows.agg(F.percentile_approx(key, points, max(10_000, 4 * count))).first()[0] or []))
    rows = rows.withColumn("_bucket", bucket_of(F.col(key), borders))
    top = rows.groupBy("_bucket").agg(F.max(F.struct(key, order)).alias("t")).select("_bucket", "t.*").collect()
    top = sorted(top, key=lambda r: -r["_bucket"])
    follows = [(here["_bucket"], after[key], after[order]) for here, after in zip(top, top[1:] + top[:1])]
    wanted = session.createDataFrame(follows, f"_of int, _key {dict(rows.dtypes)[key]}, _order {dict(rows.dtypes)[order]}")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col(order) == F.col("_order"))
    guests = rows.join(F.broadcast(wanted), same).withColumn("_bucket", F.col("_of")).select(*rows.columns)
    every = rows.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True)))
    down = Window.partitionBy("_bucket").orderBy("_guest", F.col(key).desc_nulls_last(), F.col(order).desc())
    every = prepare(every).withColumn("_next", F.lead(F.struct(*carried)).over(down)).filter("not _guest")
    plain = [F.col(f"`{c}`") for c in every.columns if c not in ("_bucket", "_guest", "_next")]
    return every.select(*plain, *[F.col("_next")[c].alias(f"next_{c}") for c in carried])


@register("op9_order_minhash")
def op9(spark, sf_dir):
    """Fingerprints of every document, of its edited text, and their likeness, also to the next document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    ready = with_next(docs, "doc_id", "text_hash", F.octet_length("text"), ["text", "tokens"],
                      lambda df: with_tokens(df, F.col("text"), "tokens"))
    n = F.length("text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    ready = ready.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    ready = with_tokens(ready, F.col("edited"), "edited_tokens")
    return ready.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("tokens")).alias("fingerprint"), shown(F.col("edited_tokens")).alias("edited_fingerprint"),
        likeness(F.col("tokens"), F.col("edited_tokens")).alias("near_edited"),
        likeness(F.col("tokens"), F.col("next_tokens")).alias("near_next"),
    )

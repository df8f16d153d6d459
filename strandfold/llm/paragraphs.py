"""Removal of paragraphs that nearly repeat: MinHash banding, exact Jaccard, clusters by connected components.

Equal paragraphs (after lower-casing A-Z and collapsing white space) are one from the start; banding, verification and
clustering work on distinct paragraphs.  A band of ``ROWS`` MinHash values agrees with probability s ** ROWS at similarity
s; with ``BANDS`` of them a pair at 0.8 is missed with probability (1 - 0.8 ** 3) ** 9 = 0.0016, and one at 0.9 with 8e-6.

Passages that repeat inside larger paragraphs, or across line ends, leave the paragraphs unlike.  Every ``PASSAGE`` consecutive
words of a text are therefore a passage of their own, known by its MinHash value: the least hash of its shingles of ``GRAM``
words.  Equal passages have equal values, and passages of equal value share ``GRAM`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandfold.llm.common import components, materialise, register, release, table
from strandfold.llm.suffixes import least_in_windows

SHINGLE = 5
SIMILAR = 0.8
ROWS = 3
BANDS = 9
LEAST_WORDS = 1
PARITY_WORDS = 4
PASSAGE = 51
GRAM = 32


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def numbers(count: int, seed: int) -> np.ndarray:
    """``count`` odd 64-bit numbers, the same everywhere."""
    return mixed(mixed(np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 32))) | np.uint64(1)


MOST_BANDS = 18
FACTORS = numbers(ROWS * MOST_BANDS, 1)
SHIFTS = numbers(ROWS * MOST_BANDS, 2)
POWERS = numbers(64, 3)


def paragraphs(text: str | None, least_words: int = LEAST_WORDS) -> list[tuple[int, list[bytes]]]:
    """(line number, lower-case words) of the lines with at least ``least_words`` words."""
    out = []
    for k, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        words = line.lower().split()
        if len(words) >= max(1, least_words):
            out.append((k, words))
    return out


def whole(text: str | None, least_words: int = 1) -> list[tuple[int, list[bytes]]]:
    """The whole text as one paragraph, in the form of ``paragraphs``; texts without words are one empty word."""
    return [(0, (text or "").encode("utf-8", "surrogatepass").lower().split() or [b""])]


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words; fewer words are one run."""
    return runs_of(word_hashes(words), size)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)


def runs_of(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for k in range(size):
        out += h[k : len(h) - size + 1 + k] * POWERS[k]
    return mixed(out)


def passage_values(h: np.ndarray) -> np.ndarray:
    """MinHash values of the passages of a text with the word hashes ``h``; fewer words are one passage."""
    if len(h) < PASSAGE:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes())], dtype=np.uint64)
    return np.unique(least_in_windows(runs_of(h, GRAM), PASSAGE - GRAM + 1))


def paragraph_id(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def parity(values: np.ndarray) -> list[int]:
    """Parities of the set's hashes over 64 * PARITY_WORDS bits: two sets differ in at least as many elements as bits."""
    flags = np.bincount((values % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(flags.astype(np.uint8), bitorder="little").view("<i8").tolist()


def band_keys(runs: list[np.ndarray], bands: int = BANDS) -> np.ndarray:
    """One key per paragraph and band, (paragraphs, bands), of the MinHash values of the band's rows."""
    every = np.concatenate(runs)
    starts = np.concatenate(([0], np.cumsum([len(r) for r in runs])[:-1]))
    keys = np.empty((len(runs), bands), dtype=np.uint64)
    for band in range(bands):
        key = np.full(len(runs), band + 1, dtype=np.uint64)
        for row in range(band * ROWS, (band + 1) * ROWS):
            value = np.minimum.reduceat(mixed(every * FACTORS[row] + SHIFTS[row]), starts)
            key = mixed(key * POWERS[7] + value)
        keys[:, band] = key
    return keys.view(np.int64)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def occurrences(
    docs: DataFrame, least_words: int, parts=paragraphs, bands: int = BANDS, keys=band_keys, passages: bool = False
) -> DataFrame:
    """(_doc, _key, line, words, pid, b0 ..): every paragraph of every text, with its band keys.

    ``parts`` cuts a text into paragraphs; with ``whole`` the texts themselves are compared.  ``keys`` makes ``bands``
    numbers of the shingles of each paragraph.  ``passages`` adds total, the words of all paragraphs of the text, and
    passages, on the row of its first paragraph the values of the passages of these words.
    """
    ddl = "_doc long, _key long, line int, words int, pid long, " + ", ".join(f"b{k} long" for k in range(bands))
    ddl += ", total int, passages array<long>" if passages else ""
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts, runs, totals, values = [], [], [], []
            for doc, key, text in zip(*[c.to_pylist() for c in batch.columns]):
                hashes = []
                for line, words in parts(text, least_words):
                    facts.append((doc, key, line, len(words), paragraph_id(words)))
                    hashes.append(word_hashes(words))
                runs += [runs_of(h) for h in hashes]
                if passages and hashes:
                    every = np.concatenate(hashes)
                    totals += [len(every)] * len(hashes)
                    values += [passage_values(every), *[every[:0]] * (len(hashes) - 1)]
            if facts:
                columns = [pa.array(c, t) for c, t in zip([*map(list, zip(*facts)), *keys(runs, bands).T], schema.types)]
                if passages:
                    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).view(np.int64)))
                    columns += [pa.array(totals, pa.int32()), lists.cast(schema.types[-1])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("_doc", "_key", "text").mapInArrow(run, ddl)


def shingle_sets(docs: DataFrame, wanted: DataFrame, least_words: int, parts=paragraphs) -> DataFrame:
    """(pid, shingles, parity) for the paragraphs at the places ``wanted`` (pid, _doc, _key, line)."""
    places = wanted.groupBy("_doc", "_key").agg(F.collect_set("line").alias("lines"))
    places = places.withColumnsRenamed({"_doc": "_d", "_key": "_k"})
    own = F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k"))
    ddl = "pid long, shingles array<long>, parity array<long>"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, marks = [], [], []
            for text, lines in zip(*[c.to_pylist() for c in batch.columns]):
                chosen = set(lines)
                for line, words in parts(text, least_words):
                    if line in chosen:
                        ids.append(paragraph_id(words))
                        values = np.unique(shingles(words))
                        sets.append(values.view(np.int64).tolist())
                        marks.append(parity(values))
            columns = [pa.array(c, t) for c, t in zip((ids, sets, marks), schema.types)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.join(places, own).select("text", "lines").mapInArrow(run, ddl).dropDuplicates(["pid"])


def verified(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity of shingles is at least ``similar``."""
    left = sets.select(F.col("pid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("pid").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared >= similar * (F.size("x") + F.size("y") - shared)).select("a", "b")


def size_class(size):
    """Sizes in steps of about 5 %."""
    return F.floor(F.log(size.cast("double")) * 20).cast("int")


def across(placed: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Pairs (a, b) of different components among ``placed`` (pid, component) that may be similar; none is missed.

    Shingles are put in order of how many paragraphs have them.  If x is not larger than y and they are similar enough, the
    first shingle that they share stands so early in both that what follows can still give the overlap they need.  So x
    files its first shingles under its size class, and y each of its first under those size classes that are still
    possible there; the exact bounds are checked as they meet, and so is a lower bound of the elements in only one set, from
    parity bits.  In each file the component with most rows is only met by rows of others.
    """
    both = similar / (1 + similar)
    each = placed.join(sets, "pid").select("pid", "component", F.size("shingles").alias("size"), F.explode("shingles").alias("token"))
    common = each.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    ordered = each.join(common, "token").groupBy("pid", "component", "size").agg(
        F.sort_array(F.collect_list(F.struct("uses", "token"))).alias("tokens"))
    size, at = F.col("size"), F.col("at")
    most = F.floor((size - at) / both + 1e-9) - size
    first = F.floor(size - 2 * both * size + 1e-9).cast("int") + 1
    small = ordered.select("pid", "component", "size", F.posexplode(F.slice("tokens", F.lit(1), first)).alias("at", "t"))
    small = small.select("pid", "component", "size", most.alias("limit"), "t", size_class(size).alias("class"))
    reach = F.floor(size - similar * size + 1e-9).cast("int") + 1
    large = ordered.select("pid", "component", "size", F.posexplode(F.slice("tokens", F.lit(1), reach)).alias("at", "t"))
    least = F.ceil(similar * size - 1e-9)
    large = large.withColumn("limit", F.least(size, most)).filter(F.col("limit") >= least)
    large = large.select("pid", "component", "size", "limit", "t", F.explode(
        F.sequence(size_class(least), size_class(F.col("limit")))).alias("class"))
    filed = small.withColumn("role", F.lit(0)).unionByName(large.withColumn("role", F.lit(1)))
    filed = filed.select("pid", "component", F.xxhash64("t.token", "class").alias("file"), "role", "size", "limit")
    marks = [F.col("parity")[k].alias(f"p{k}") for k in range(PARITY_WORDS)]
    filed = materialise(filed.join(sets.select("pid", *marks), "pid"), "paragraph-files")
    parts = filed.groupBy("file", "component").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("file").agg(F.max(F.struct("n", "component")).alias("m"), F.count(F.lit(1)).alias("parts"))
    main = main.filter("parts > 1").select("file", F.col("m.component").alias("main"))
    others = filed.join(main, "file").filter("component <> main").select(
        "file", F.col("role").alias("ra"), F.col("pid").alias("a"), F.col("component").alias("ca"),
        F.col("size").alias("sa"), F.col("limit").alias("la"), *[F.col(f"p{k}").alias(f"x{k}") for k in range(PARITY_WORDS)])
    any_ = filed.withColumnsRenamed({"role": "rb", "pid": "b", "component": "cb", "size": "sb", "limit": "lb"})
    apart = " + ".join(f"bit_count(x{k} ^ p{k})" for k in range(PARITY_WORDS))
    met = others.join(any_, "file").filter(
        "ra <> rb and ca <> cb and sa <= lb and sb <= la and if(ra < rb, sa <= sb, sb <= sa) "
        f"and {apart} <= {(1 - similar) / (1 + similar)!r} * (sa + sb) + 1e-9")
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs.files = filed
    return pairs


def links(
    docs: DataFrame, found: DataFrame, least_words: int = LEAST_WORDS, parts=paragraphs, bands: int = BANDS
) -> DataFrame:
    """Verified links (a, b) between distinct paragraphs, enough to give all components of colliding pairs.

    First every member of a bucket meets the bucket's hub, the member whose other buckets are fullest; that is one pair per
    member however large the bucket.  Pairs inside one component need no further look, so only buckets that still hold
    several components go on, and of their members only pairs across components that can still be similar are compared.
    """
    least = F.min(F.struct("_doc", "_key", "line"))
    distinct = found.groupBy("pid").agg(least.alias("at"), *[F.min(f"b{k}").alias(f"b{k}") for k in range(bands)])
    filed = distinct.select("pid", F.explode(F.array(*[f"b{k}" for k in range(bands)])).alias("bucket"))
    shared = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialise(filed.join(shared, "bucket"), "paragraph-buckets")
    fullness = members.groupBy("pid").agg(F.sum("n").alias("full"))
    hubs = members.join(fullness, "pid").groupBy("bucket").agg(F.max(F.struct("full", "pid")).alias("hub"))

    places = found.groupBy("pid").agg(least.alias("at")).join(fullness, "pid", "left_semi").select("pid", "at.*")
    sets = materialise(shingle_sets(docs, places, least_words, parts), "paragraph-shingles")

    first = members.join(hubs.select("bucket", "hub.pid").withColumnRenamed("pid", "hub"), "bucket").filter("pid <> hub")
    first = first.select(F.least("hub", "pid").alias("a"), F.greatest("hub", "pid").alias("b")).distinct()
    near = materialise(verified(first, sets), "paragraph-links")
    part = components(near).withColumnRenamed("node", "pid")
    placed = members.select("bucket", "pid").join(part, "pid", "left")
    placed = placed.withColumn("component", F.coalesce("component", "pid"))
    several = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    rest = materialise(placed.join(several, "bucket", "left_semi").select("pid", "component").distinct(), "paragraph-rest")
    pairs = across(rest, sets)
    out = materialise(near.unionByName(verified(pairs, sets)), "paragraph-all-links")
    release(members, sets, near, rest, pairs.files)
    return out


def near_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(_doc, _key, line, words, total, cluster, copies, first_doc, removed) of paragraphs that have near copies.

    A cluster is a component of links; its first occurrence by (doc_id, text hash, line) stays and the others are removed.
    Rows with equal id and text count as one document.  Paragraphs of fewer than ``least_words`` words are left alone, and so
    are null and empty texts; null ids come first.  total counts the words of all paragraphs of the document.  The table of
    all paragraphs stays as ``occurrences`` of the result.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("_doc"), "text", F.xxhash64("text").alias("_key"))
    found = materialise(occurrences(keyed, least_words, passages=True), "paragraphs")
    linked = links(keyed, found, least_words)
    part = components(linked).withColumnsRenamed({"node": "pid", "component": "cluster"})
    release(linked)
    placed = found.select("_doc", "_key", "line", "words", "total", "pid").distinct().join(part, "pid", "left")
    placed = placed.withColumn("cluster", F.coalesce("cluster", "pid")).drop("pid")
    sizes = placed.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("_doc", "_key", "line")).alias("kept")).filter("copies > 1")
    joined = placed.join(sizes, "cluster")
    stays = F.struct("_doc", "_key", "line").eqNullSafe(F.col("kept"))
    out = joined.select(
        "_doc", "_key", "line", "words", "total", "cluster", "copies", F.col("kept")["_doc"].alias("first_doc"),
        (~stays).alias("removed"))
    out.occurrences = found
    return out


def classes(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """(node, n_passages, class_id) of the documents that share a passage with another one; node is the hash of _doc and _key.

    ``found`` are the paragraphs with their passages, ``repeated`` those with near copies.  Passages are those of
    ``occurrences`` and the near-repeated paragraphs of ``PASSAGE`` words, or of nearly all words of their document; other
    short lines put no documents together.  A class is a component of documents that share passages, class_id its smallest
    doc_id, and n_passages counts the passages of the document that others hold, too.
    """
    node = F.xxhash64("_doc", "_key").alias("node")
    lines = repeated.filter((F.col("words") >= PASSAGE) | (F.col("words") >= SIMILAR * F.col("total")))
    held = found.select(node, F.explode("passages").alias("passage")).unionByName(
        lines.select(node, F.xxhash64(F.lit("line"), "cluster").alias("passage")))
    several = held.groupBy("passage").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub <> last")
    shared = held.join(several.select("passage", "hub"), "passage").distinct()
    shared = materialise(shared, "shared-passages")
    part = components(shared, "node", "hub")
    least = part.join(found.select(node, "_doc").distinct(), "node").groupBy("component").agg(F.min("_doc").alias("class_id"))
    counts = shared.groupBy("node").agg(F.count(F.lit(1)).alias("n_passages"))
    out = materialise(counts.join(part, "node").join(least, "component").drop("component"), "classes")
    release(shared)
    return out


def by_document(docs: DataFrame, repeated: DataFrame, classed: DataFrame) -> DataFrame:
    """(doc_id, n_shared, n_removed, words_removed, removed_lines, clusters, component_id, first_doc_id, n_passages) per row.

    component_id is the smallest doc_id of the document's class (``classes``), or its own id.  first_doc_id is the smallest one
    among the documents that hold copies of its paragraphs, short lines included.
    """
    gone = F.when(F.col("removed"), F.col("line"))
    per = repeated.groupBy("_doc", "_key").agg(
        F.count(F.lit(1)).alias("n_shared"), F.count(gone).alias("n_removed"),
        F.coalesce(F.sum(F.when(F.col("removed"), F.col("words"))), F.lit(0)).cast("long").alias("words_removed"),
        F.array_sort(F.collect_list(gone)).alias("removed_lines"), F.array_sort(F.collect_set("cluster")).alias("clusters"),
        F.min("first_doc").alias("least"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("_k"))
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.col("_k") == F.col("_key"))
    out = rows.join(per, own, "left").withColumn("node", F.xxhash64(F.col("doc_id").cast("long"), "_k"))
    out = out.join(classed, "node", "left")
    none = F.array().cast("array<int>")
    return out.select(
        "doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_shared", "n_removed", "words_removed")],
        F.coalesce("removed_lines", none).alias("removed_lines"),
        F.coalesce("clusters", F.array().cast("array<bigint>")).alias("clusters"),
        F.coalesce("class_id", F.col("doc_id").cast("long")).alias("component_id"),
        F.coalesce("least", F.col("doc_id").cast("long")).alias("first_doc_id"),
        F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"))


def without_repeats(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` with the removed paragraphs cut out of their texts, together with their line ends."""
    gone = repeated.filter("removed").groupBy("_doc", "_key").agg(F.collect_set("line").alias("_lines"))
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_key"))
    joined = docs.join(gone, own, "left")
    kept = F.filter(F.split("text", "\n", -1), lambda line, k: ~F.array_contains("_lines", k))
    text = F.when(F.col("_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


@register("op2_paragraph_minhash")
def op2(spark, sf_dir):
    """Near-repeated paragraphs of every document and the class of documents that it shares passages with."""
    docs = table(spark, sf_dir, "documents")
    found = near_repeats(docs)
    repeated = materialise(found, "repeated-paragraphs")
    classed = classes(found.occurrences, repeated)
    release(found.occurrences)
    return by_document(docs, repeated, classed)

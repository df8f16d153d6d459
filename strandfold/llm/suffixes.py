"""Removal of long repeated byte strings with a sparse suffix array, sorted deep-shallow.

Any ``LENGTH``-byte string holds a winnowed anchor: the gram of ``GRAM`` bytes with the least hash, the leftmost of equal
ones.  Equal strings have their anchor at the same offset, so a string can only repeat among the occurrences of its anchor
gram, and only suffixes at anchors need sorting.  The text from the first to the end of the last string of one anchor is
its segment.

1. Segments are counted by hash.  All strings of a segment that occurs twice repeat.
2. The strings of a segment are filed by how many bytes they have before the anchor: ranges of that number, each under a hash
   of the bytes that all strings of the range hold.  Segments alone under their file share nothing there.
3. Segments under one file are sorted by their right contexts and by their reversed left ones: a multikey quicksort down to a
   shallow depth, then blind tries for the groups that share a longer prefix.  With the common prefixes of both orders, each
   segment gets the strings it shares with another one.
4. A file with more segments than a task should sort is divided first: its ranges are cut into smaller ones, whose files hold
   more bytes of the strings, down to single strings.  If a segment shares all bytes of a range with another one, the
   whole range repeats and is not divided.  A segment is in few files of a size, as only the ends of what it shares matter.

Matches never cross documents, as segments lie inside one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandfold.llm.common import materialise, register, release, table

LENGTH = 400
GRAM = 32
SHALLOW = 24
TOGETHER = 256  # segments that one task sorts together; larger files are divided, to the same result
DIVISIONS = 4
CHUNK = 1 << 22
POSITION_BITS = 23
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                        0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes from every position; ``gram`` is a power of two."""
    h, step, k = data.astype(np.uint64) + np.uint64(1), 1, 0
    while step < gram:
        h = h[:-step] * MULTIPLIERS[k % 4] + h[step:]
        step, k = 2 * step, k + 1
    h ^= h >> np.uint64(29)
    h *= MULTIPLIERS[4]
    h ^= h >> np.uint64(32)
    return h


def least_in_windows(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of every ``width`` consecutive ones."""
    least, step = keys, 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    rest = width - step
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """Arrays (anchor, first, last, gram hash): the strings from first to last (starts) have this anchor.

    Very long texts are worked through in chunks that overlap by a string, which moves no anchor.
    """
    out = []
    grams = length - gram + 1
    for base in range(0, max(1, len(data) - length + 1), CHUNK):
        part = np.frombuffer(data, dtype=np.uint8)[base : base + CHUNK + length - 1]
        if len(part) < length:
            continue
        h = gram_hashes(part, gram)
        place = np.arange(len(h), dtype=np.uint64)
        keys = (h >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | place
        at = (least_in_windows(keys, grams) & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
        new = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate(([0], new))
        last = np.concatenate((new - 1, [len(at) - 1]))
        spot = at[first]
        out.append((spot + base, first + base, last + base, h[spot].view(np.int64)))
    if not out:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*out))


# ---- deep-shallow sorting -------------------------------------------------------------------------------------


def words_at(texts: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from ``depth`` of zero-padded rows as big-endian numbers."""
    return np.ascontiguousarray(texts[:, depth : depth + 8]).view(">u8")[:, 0].astype(np.uint64)


def multikey(texts: np.ndarray, rows: np.ndarray, depth: int, out: list[np.ndarray], deep) -> None:
    """Ternary quicksort of ``rows`` on one 8-byte key at a time; groups still equal at SHALLOW go to ``deep``."""
    todo = [(rows, depth)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) <= 1:
            out.append(rows)
            continue
        if depth >= SHALLOW:
            out.append(deep(rows))
            continue
        keys = words_at(texts[rows], depth)
        pivot = np.sort(keys)[len(keys) // 2]
        below, above = keys < pivot, keys > pivot
        same = ~(below | above)
        todo += [(rows[above], depth), (rows[same], depth + 8), (rows[below], depth)]


class BlindTrie:
    """A compacted trie over texts that keeps branch depths and branching bytes only.

    Insertion walks down by the bytes at the branch depths, not looking at what lies between, to some leaf; one comparison
    with that leaf gives the length of the common prefix and thereby the place of the new branch.  Texts that end are
    ordered before longer ones; equal texts share a leaf.
    """

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.root = None

    def byte(self, k: int, depth: int) -> int:
        text = self.texts[k]
        return text[depth] if depth < len(text) else -1

    def insert(self, k: int) -> None:
        if self.root is None:
            self.root = [k]
            return
        path, node = [], self.root
        while isinstance(node, tuple):
            depth, children = node
            path.append(node)
            byte = self.byte(k, depth)
            node = children.get(byte)
            if node is None:
                node = next(iter(children.values()))
        leaf = node[0]
        shared = common(self.texts[k], self.texts[leaf])
        if shared == len(self.texts[k]) == len(self.texts[leaf]):
            node.append(k)
            return
        above = None
        for step in path:
            if step[0] >= shared:
                break
            above = step
        below = self.root if above is None else above[1].get(self.byte(k, above[0]))
        if isinstance(below, tuple) and below[0] == shared:
            below[1][self.byte(k, shared)] = [k]
            return
        branch = (shared, {self.byte(k, shared): [k], self.byte(leaf, shared): below})
        if above is None:
            self.root = branch
        else:
            above[1][self.byte(k, above[0])] = branch

    def order(self) -> list[int]:
        out, todo = [], [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += [child for _, child in sorted(node[1].items(), key=lambda c: -c[0])]
            else:
                out += node
        return out


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def sort_deep_shallow(texts: list[bytes]) -> np.ndarray:
    """Order of the texts: multikey quicksort on the first SHALLOW bytes, blind tries below."""
    heads = np.zeros((len(texts), SHALLOW), dtype=np.uint8)
    for k, t in enumerate(texts):
        head = t[:SHALLOW]
        heads[k, : len(head)] = np.frombuffer(head, dtype=np.uint8)

    def deep(rows: np.ndarray) -> np.ndarray:
        trie = BlindTrie(texts)
        for k in rows.tolist():
            trie.insert(k)
        return np.array(trie.order())

    out: list[np.ndarray] = []
    multikey(heads, np.arange(len(texts)), 0, out, deep)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def shared_prefixes(texts: list[bytes]) -> np.ndarray:
    """Matrix of the common prefix lengths of all texts, from their sorted order and its neighbours' prefixes."""
    n = len(texts)
    order = sort_deep_shallow(texts)
    next_to = [common(texts[a], texts[b]) for a, b in zip(order[:-1], order[1:])]
    sorted_ = np.zeros((n, n), dtype=np.int32)
    for k in range(n - 1):
        sorted_[k, k + 1 :] = np.minimum.accumulate(next_to[k:])
    sorted_ += sorted_.T
    out = np.zeros_like(sorted_)
    out[np.ix_(order, order)] = sorted_
    return out


def shared_strings(segments: list[tuple[bytes, int]], low: int, high: int, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each (bytes, anchor offset) the ranges covered by strings it shares with another one.

    Only strings with ``low`` to ``high`` bytes before the anchor are looked at.
    """
    rights = shared_prefixes([s[a:] for s, a in segments])
    lefts = shared_prefixes([s[:a][::-1] for s, a in segments])
    first, last = np.maximum(length - rights, low), np.minimum(lefts, high)
    whole = first <= last
    np.fill_diagonal(whole, False)
    out = []
    for k, (_, anchor) in enumerate(segments):
        ends = np.flatnonzero(whole[k])
        # every such range holds the anchor, so their union is one range
        out.append([(anchor - int(last[k, ends].max()), anchor + length - int(first[k, ends].min()))] if len(ends) else [])
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges [start, end) joined where they touch or overlap, in order."""
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


# ---- Spark jobs -----------------------------------------------------------------------------------------------

TEXT_KEY = ["_doc", "_text_key"]
ANCHORS = "_doc long, _text_key long, copies long, spot long, s1 long, s2 long, gram long"
# An anchor's place in one number: position, and how far before it its first and last strings start.
BACK_BITS = 9


def unpack(spot: int) -> tuple[int, int, int]:
    mask = (1 << BACK_BITS) - 1
    anchor = spot >> (2 * BACK_BITS)
    return anchor, anchor - ((spot >> BACK_BITS) & mask), anchor - (spot & mask)


def anchor_table(docs: DataFrame) -> DataFrame:
    """One row per anchor: text key, place, 128-bit hash of its segment, hash of its gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        low = (1 << 64) - 1
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for doc, key, copies, text in zip(*[c.to_pylist() for c in batch.columns]):
                data = (text or "").encode("utf-8", "surrogatepass")
                if len(data) < LENGTH:
                    continue
                at, first, last, gram = anchors(data)
                spots = (at << (2 * BACK_BITS)) | ((at - first) << BACK_BITS) | (at - last)
                hashes = [digest(data[a : b + LENGTH]) for a, b in zip(first.tolist(), last.tolist())]
                n = len(at)
                for column, values in zip(columns, (
                    [doc] * n, [key] * n, [copies] * n, spots.tolist(), [(h & low) - (1 << 63) for h in hashes],
                    [(h >> 64) - (1 << 63) for h in hashes], gram.tolist(),
                )):
                    column += values
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["_doc", "_text_key", "copies", "spot", "s1", "s2", "gram"])

    return docs.select("_doc", "_text_key", "copies", "text").mapInArrow(run, ANCHORS)


def marked_anchors(docs: DataFrame) -> DataFrame:
    """(_doc, _text_key, marks): per text its anchors that need work, as (spot, gram, state).

    state 0: the whole segment repeats; 1: it is compared with the gram's other segments; 3: it repeats and also stands for
    itself in the comparison, by one of its occurrences.
    """
    found = materialise(anchor_table(docs), "anchors")
    pick = F.xxhash64("_doc", "_text_key", "spot")
    segments = found.groupBy("s1", "s2").agg(
        F.sum("copies").alias("n"), F.min("gram").alias("gram"), F.min(pick).alias("pick"))
    grams = segments.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    states = segments.join(grams, "gram", "left").filter("n > 1 or kinds is not null")
    joined = found.drop("gram").join(states, ["s1", "s2"])
    stands = (F.col("pick") == pick) & F.col("kinds").isNotNull()
    state = F.when(F.col("n") == 1, 1).otherwise(F.when(stands, 3).otherwise(0))
    mark = F.struct("spot", "gram", state.cast("int").alias("state"))
    marks = joined.select(*TEXT_KEY, mark.alias("mark")).groupBy(*TEXT_KEY).agg(F.collect_list("mark").alias("marks"))
    marks.anchors = found
    return marks


MARKS = "array<struct<spot:long,gram:long,state:int>>"
RANGE = "array<struct<start:long,end:long>>"


DONE = f"n_bytes long, spans {RANGE}, kept_sha256 string, kept binary"


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the spans."""
    edges = [0, *[e for span in spans for e in span], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def summary(data: bytes, spans: list[tuple[int, int]], with_kept: bool) -> tuple:
    kept = cut(data, spans)
    shown = [{"start": a, "end": b} for a, b in spans]
    return len(data), shown, hashlib.sha256(kept).hexdigest(), kept if with_kept else None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)


def _arrow(spark_schema: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(spark_schema))


OPEN = f"_doc long, _text_key long, copies long, data binary, ranges {RANGE}, todo {MARKS}, {DONE}"


def first_pass(docs: DataFrame, marks: DataFrame, with_kept: bool) -> DataFrame:
    """Per document its result, or, where marks are still to be worked out, its bytes and what is known so far."""
    schema = _arrow(OPEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, key, copies, text, found in zip(*[c.to_pylist() for c in batch.columns]):
                data = (text or "").encode("utf-8", "surrogatepass")
                places = [(unpack(m["spot"]), m) for m in found or []]
                spans = merged([(s, e + LENGTH) for (_, s, e), m in places if m["state"] in (0, 3)])
                todo = [m for _, m in places if m["state"]]
                if not todo:
                    rows.append((doc, key, copies, None, None, None, *summary(data, spans, with_kept)))
                else:
                    shown = [{"start": a, "end": b} for a, b in spans]
                    rows.append((doc, key, copies, data, shown, todo, len(data), None, None, None))
            yield _batch(rows, schema)

    renamed = marks.withColumnsRenamed({"_doc": "_d", "_text_key": "_k"})
    own = F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_text_key") == F.col("_k"))
    joined = docs.join(renamed, own, "left").select("_doc", "_text_key", "copies", "text", "marks")
    return joined.mapInArrow(run, OPEN)


SEGMENT = "_doc long, _text_key long, spot long, unique boolean, gram long, segment binary"
FILE = ["gram", "low", "high", "c1", "c2"]
FILED = "_doc long, _text_key long, spot long, gram long, low int, high int, c1 long, c2 long, f1 long, f2 long"
WIDEST = LENGTH - GRAM


def two_longs(data: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(data)
    return (h & ((1 << 64) - 1)) - (1 << 63), (h >> 64) - (1 << 63)


def segment_table(opened: DataFrame) -> DataFrame:
    """The bytes of every segment that is compared with others, once per distinct segment."""
    schema = _arrow(SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, key, data, todo in zip(*[c.to_pylist() for c in batch.columns]):
                for m in todo:
                    _, first, last = unpack(m["spot"])
                    rows.append((doc, key, m["spot"], m["state"] == 1, m["gram"], data[first : last + LENGTH]))
            yield _batch(rows, schema)

    return opened.select(*TEXT_KEY, "data", "todo").mapInArrow(run, SEGMENT)


def filed(ranges: DataFrame) -> DataFrame:
    """Files of the parts of ranges (SEGMENT without unique, low, high): hashes of what all strings of a part hold (c1, c2)
    and of what they hold together (f1, f2; null if the segment has not all of them)."""
    schema = _arrow(FILED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, key, spot, gram, data, low, high in zip(*[c.to_pylist() for c in batch.columns]):
                at, first, last = unpack(spot)
                edges = sorted({low + (high + 1 - low) * k // DIVISIONS for k in range(DIVISIONS + 1)})
                for a, b in zip(edges[:-1], edges[1:]):
                    b, here = b - 1, at - first
                    if here < a or at - last > b:
                        continue  # no string of the segment is in this part
                    core = two_longs(data[here - a : here + LENGTH - b])
                    full = two_longs(data[here - b : here + LENGTH - a]) if here >= b and at - last <= a else (None, None)
                    rows.append((doc, key, spot, gram, a, b, *core, *full))
            yield _batch(rows, schema)

    return ranges.select(*TEXT_KEY, "spot", "gram", "segment", "low", "high").mapInArrow(run, FILED)


def with_segment(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """``rows`` (_doc, _text_key, spot, ...) with the bytes of their segments."""
    renamed = segments.withColumnsRenamed({"_doc": "_d", "_text_key": "_k", "spot": "_s"}).drop("gram")
    own = F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_text_key") == F.col("_k")) & (F.col("spot") == F.col("_s"))
    return rows.join(renamed, own).drop("_d", "_k", "_s")


def compared(opened: DataFrame, together: int) -> DataFrame:
    """(_doc, _text_key, ranges): strings that segments share with other segments of their gram."""
    segments = materialise(segment_table(opened), "segments")
    todo = segments.withColumns({"low": F.lit(0), "high": F.lit(WIDEST)})
    alone = [c for c in FILED.replace(" long", "").replace(" int", "").split(", ")]
    small, whole = [], []
    while True:
        files = materialise(filed(todo), "files")
        sizes = files.groupBy(*FILE).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = materialise(files.join(sizes, FILE), "shared")
        small.append(shared.filter(F.col("n") <= together).select(*alone))
        large = shared.filter(F.col("n") > together)
        release(files)
        if large.isEmpty():
            break
        full = ["gram", "low", "high", "f1", "f2"]
        own = F.xxhash64(*TEXT_KEY, "spot")
        twice = large.filter("f1 is not null").groupBy(*full).agg(
            F.count(F.lit(1)).alias("same"), F.min(own).alias("pick")).filter("same > 1")
        large = materialise(large.join(twice, full, "left"), "large")
        whole.append(large.filter("same is not null"))
        # of segments that share a whole range, one stands for all in the comparison with the others
        rest = large.filter("low < high").filter(F.col("same").isNull() | (F.col("pick") == own))
        todo = with_segment(rest.select(*TEXT_KEY, "spot", "gram", "low", "high"), segments)
    found = [sorted_files(with_segment(rows, segments)) for rows in small]
    at, back = F.shiftright("spot", 2 * BACK_BITS), F.col("high")
    span = F.struct((at - back).alias("start"), (at + LENGTH - F.col("low")).alias("end"))
    found += [rows.select(*TEXT_KEY, F.array(span).alias("ranges")) for rows in whole]
    return reduce(DataFrame.unionAll, found)


def sorted_files(rows: DataFrame) -> DataFrame:
    """(_doc, _text_key, ranges) of files that are small enough for a task; tasks get many of them."""
    out_ddl = f"_doc long, _text_key long, ranges {RANGE}"
    out_schema = _arrow(out_ddl)

    def solve(file: tuple, group: list[tuple]) -> list[tuple]:
        held = []
        for _, _, spot, _, data in group:
            at, first, _ = unpack(spot)
            # no more than the strings of the range reach
            start = max(0, at - first - file[2])
            held.append((data[start : at - first + LENGTH - file[1]], at - first - start))
        found = shared_strings(held, file[1], file[2])
        return [
            (g[0], g[1], [{"start": (g[2] >> 2 * BACK_BITS) - here + a, "end": (g[2] >> 2 * BACK_BITS) - here + b} for a, b in ranges])
            for g, (_, here), ranges in zip(group, held, found) if g[3] and ranges
        ]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        file = None
        for batch in batches:
            made = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if group and file != row[:5]:
                    made += solve(file, group)
                    group = []
                file = row[:5]
                group.append(row[5:])
            yield _batch(made, out_schema)
        yield _batch(solve(file, group) if group else [], out_schema)

    dealt = rows.select(*FILE, *TEXT_KEY, "spot", "unique", "segment").repartition(*FILE).sortWithinPartitions(*FILE)
    return dealt.mapInArrow(meet, out_ddl)


def repeats(docs: DataFrame, together: int = TOGETHER, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans, kept_sha256, kept) per row of ``docs``, of its text as UTF-8; other columns are left out.

    spans are the maximal byte ranges [start, end) covered by ``LENGTH``-byte strings that also start anywhere else, in the
    same text or in that of another row; rows with equal ids and texts repeat each other.  Null counts as empty; texts
    shorter than ``LENGTH`` have no span.  kept, the bytes outside the spans, is null unless ``with_kept``.  ``together``
    bounds what one task sorts and changes no result.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("_text_key", F.xxhash64("text"))
    # rows with equal id and text are worked on once; all their strings repeat
    again = materialise(keyed.groupBy(*TEXT_KEY).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "again")
    twins = None
    if not again.isEmpty():
        renamed = again.withColumnsRenamed({"_doc": "_d", "_text_key": "_k"})
        own = F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_text_key") == F.col("_k"))
        twins = keyed.join(renamed, own).drop("_d", "_k")
        keyed = keyed.join(renamed, own, "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(
            twins.groupBy(*TEXT_KEY).agg(F.first("text").alias("text"), F.first("copies").alias("copies")))
    else:
        keyed = keyed.withColumn("copies", F.lit(1).cast("long"))
    marks = marked_anchors(keyed)
    known = materialise(first_pass(keyed, marks, with_kept), "repeats")
    release(marks.anchors)
    opened = known.filter("data is not null")
    more = compared(opened, together)
    more = more.groupBy(*TEXT_KEY).agg(F.flatten(F.collect_list("ranges")).alias("more"))
    more = more.withColumnsRenamed({"_doc": "_d", "_text_key": "_k"})
    schema = _arrow(f"_doc long, {DONE}")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, data, ranges, extra in zip(*[c.to_pylist() for c in batch.columns]):
                spans = merged([(r["start"], r["end"]) for r in [*ranges, *(extra or [])]])
                rows.append((doc, *summary(data, spans, with_kept)))
            yield _batch(rows, schema)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(*[c.to_pylist() for c in batch.columns]):
                data = text.encode("utf-8", "surrogatepass")
                rows.append((doc, *summary(data, [(0, len(data))] if len(data) >= LENGTH else [], with_kept)))
            yield _batch(rows, schema)

    own = F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_text_key") == F.col("_k"))
    single = opened.filter("copies = 1")
    late = single.select(*TEXT_KEY, "data", "ranges").join(more, own, "left").select("_doc", "data", "ranges", "more")
    late = late.mapInArrow(finish, f"_doc long, {DONE}")
    done = known.filter("data is null and copies = 1").select(*late.columns).unionByName(late)
    if twins is not None:
        done = done.unionByName(twins.select("_doc", "text").mapInArrow(repeated, f"_doc long, {DONE}"))
    return done.withColumnRenamed("_doc", "doc_id")


@register("op10_suffix_dedup")
def op10(spark, sf_dir):
    """How much of every document repeats elsewhere, and the digest of the rest."""
    found = repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")

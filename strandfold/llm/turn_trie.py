"""Prefix trie of conversations by burst tries: heads for crowded prefixes, containers of suffixes below them.

A conversation is a sequence of turn ids (digests of role and text).  All start in one container under the root.  The size of
a container is the number of its suffixes and of the turns in them; one of more than ``CONTAINER`` bursts by the next turn id
into one container per id, and the node it hung from becomes part of the trie's head.  Which prefixes end up as heads does not
depend on the order of the bursts: those with more than ``CONTAINER`` below them.  So one aggregation over the prefixes tells
all bursts of all depths, and no burst gathers a container.

What is left are containers of bounded size.  Spark deals them to tasks, each is sorted and swept once, the open path on a
stack, which gives its nodes.  The nodes of the head are aggregations over the conversations that pass through them.  Sums
over the subtree of a head use that every node is credited to one conversation, its smallest member: along a conversation
these credits are summed up from its end, and a head adds up those of its members.

A prefix is known by its depth and two 64-bit sums (exclusive or) of hashes of its (place, turn id) pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandfold.functions.skew import BROADCAST_ROWS, spread_join
from strandfold.llm.common import materialise, register, table

CONTAINER = 4_096
STRETCH = 4_096  # places of one conversation that a window holds together
NODE = ["depth", "k1", "k2"]
NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string"
)
RESULT = [c.split()[0] for c in NODES.split(", ")]


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn: a digest of the length of the role, the role and the text."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(F.encode(whole, "utf-8"), 256)), 1, 16)


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, place, id, bytes): the turns of every conversation, numbered from 1 in order of turn, nulls first.

    Null roles and texts count as empty, equal turn numbers go by turn id, repeated rows are turns of their own, and rows
    without conv_id belong to no conversation.  The order is one range partitioning of all rows, so that a conversation
    with a large share of them is spread over tasks as well; only conversations over a border need an offset.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    known = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_id(role, text).alias("id"),
        F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("id")]
    placed = known.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    placed = materialise(placed, "turns").withColumn("part", F.shiftright("row", 33))
    counts = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    # two rows per border of two partitions at most
    offsets = counts.withColumn("before", before).filter("before is not null").drop("n")
    here = F.row_number().over(W.partitionBy("conv_id", "part").orderBy("row"))
    joined = placed.withColumn("here", here.cast("long")).join(F.broadcast(offsets), ["conv_id", "part"], "left")
    return joined.select("conv_id", (F.col("here") + F.coalesce("before", F.lit(0))).alias("place"), "id", "bytes")


def running(rows: DataFrame, key: str, place: Column, values: dict, longest: int) -> DataFrame:
    """``rows`` with running totals along ``place`` per ``key``: values maps a name to (aggregate, column, combine).

    Windows hold one stretch of a key only; what lies before the stretch is added from the totals of stretches, which are
    only worked out if some key is longer than a stretch.
    """
    cut = rows.withColumn("_place", place).withColumn("_cut", F.floor(F.col("_place") / STRETCH))
    up_to = W.partitionBy(key, "_cut").orderBy("_place").rangeBetween(W.unboundedPreceding, 0)
    made = cut.withColumns({name: agg(column).over(up_to) for name, (agg, column, _) in values.items()})
    if longest >= STRETCH:
        totals = cut.groupBy(key, "_cut").agg(*[agg(column).alias(f"_{n}") for n, (agg, column, _) in values.items()])
        earlier = W.partitionBy(key).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)
        totals = totals.withColumns({f"_{n}": agg(f"_{n}").over(earlier) for n, (agg, _, _) in values.items()})
        made = made.join(totals, [key, "_cut"], "left").withColumns(
            {n: F.coalesce(both(F.col(n), F.col(f"_{n}")), n) for n, (_, _, both) in values.items()})
    return made.drop("_place", "_cut", *[f"_{n}" for n in values])


def prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """(conv_id, depth, len, bytes, id) with the keys (k1, k2) of the prefix and (p1, p2) of the one before it."""
    own = [F.xxhash64(F.lit(seed), "depth", "id") for seed in (1, 2)]
    rows = turns.withColumns({"_x1": own[0], "_x2": own[1]})
    xor = lambda a, b: a.bitwiseXOR(b)
    rows = running(rows, "conv_id", F.col("depth"), {
        "k1": (F.bit_xor, F.col("_x1"), xor), "k2": (F.bit_xor, F.col("_x2"), xor)}, longest)
    parent = {f"p{k}": xor(F.col(f"k{k}"), F.col(f"_x{k}")) for k in (1, 2)}
    return rows.withColumns(parent).drop("_x1", "_x2")


def ends_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


class Open:
    """A node whose subtree is being read."""

    __slots__ = ("depth", "bytes", "least", "n", "ends", "leaves", "saved", "below")

    def __init__(self, depth: int, size: int):
        self.depth, self.bytes, self.least, self.n, self.ends = depth, size, None, 0, []
        self.leaves, self.saved, self.below = 0, 0, []

    def close(self) -> list:
        """The node's row; its children get to know their parent."""
        for child in self.below:
            child[2] = self.least
        leaves = self.leaves if self.below else 1
        saved = self.saved + (self.n - 1) * self.bytes
        return [self.least, self.depth, None, self.n, len(self.below), leaves, saved, ends_digest(self.ends)]

    def add(self, row: list) -> None:
        self.below.append(row)
        self.see(row[0], row[3])
        self.leaves += row[5]
        self.saved += row[6]

    def see(self, least: int, n: int) -> None:
        self.least = least if self.least is None else min(self.least, least)
        self.n += n


def sweep(container: list[tuple[int, list]]) -> Iterator[list]:
    """Rows of the nodes of one container of sorted (conv_id, suffix as (depth, id, bytes) triples), its top node last."""
    path: list[Open] = []
    before: list = []
    for conv, suffix in [*container, (None, [])]:
        shared = 0
        while shared < min(len(before), len(suffix)) and before[shared][1] == suffix[shared][1]:
            shared += 1
        while len(path) > shared:
            row = path.pop().close()
            if path:
                path[-1].add(row)
            yield row
        path += [Open(depth, size) for depth, _, size in suffix[shared:]]
        if path:
            path[-1].see(conv, 1)
            path[-1].ends.append(conv)
        before = suffix


def swept(containers: DataFrame) -> DataFrame:
    """Nodes of all containers: the columns of a node, whether it is the top of its container, and the key of its parent."""
    ddl = f"{NODES}, top boolean, p1 long, p2 long"
    names = [c.split()[0] for c in ddl.split(", ")]
    kinds = [pa.string() if n == "ends_sha256" else pa.bool_() if n == "top" else pa.int64() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        key = None

        def solved() -> Iterator[list]:
            for row in sweep(held):
                yield row, row[1] == key[0]

        def packed(rows: list) -> pa.RecordBatch:
            out = [[*row, top, *(parent if top else (None, None))] for row, top, parent in rows]
            columns = zip(*out) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

        for batch in batches:
            rows = []
            depth, k1, k2, p1, p2, conv, suffix = [c.to_pylist() for c in batch.columns]
            for k in range(batch.num_rows):
                this = (depth[k], k1[k], k2[k])
                if this != key and held:
                    rows += [(row, top, parent) for row, top in solved()]
                    held = []
                key, parent = this, (p1[k], p2[k])
                held.append((conv[k], [(t["depth"], t["id"], t["bytes"]) for t in suffix[k]]))
            yield packed(rows)
        yield packed([(row, top, parent) for row, top in solved()] if held else [])

    dealt = containers.repartition(*NODE).sortWithinPartitions(*NODE, "suffix", "conv_id")
    return dealt.select(*NODE, "p1", "p2", "conv_id", "suffix").mapInArrow(run, ddl)


def head_ends(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the heads where conversations end; ``ends`` has (depth, k1, k2, conv_id).

    SHA-256 needs the ids one after another.  Tasks over ranges of (node, conv_id) first join runs of ids to strings, so that
    one node's final task streams a few long strings and never holds its members.
    """
    made = "depth long, k1 long, k2 long, first long, ids string"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def packed(rows):
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds)], ["depth", "k1", "k2", "first", "ids"])

        for batch in batches:
            rows = []
            for *this, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if ids and (this != key or len(ids) >= STRETCH):
                    rows.append((*key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = this
                ids.append(conv)
            yield packed(rows)
        yield packed([(*key, ids[0], ",".join(map(str, ids)))] if ids else [])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        names, kinds = [*NODE, "ends_sha256"], [pa.int64()] * 3 + [pa.string()]

        def packed(rows):
            columns = list(zip(*rows)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

        for batch in batches:
            rows = []
            for *this, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if this == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    rows.append((*key, digest.hexdigest()))
                key, digest = this, hashlib.sha256(ids.encode())
            yield packed(rows)
        yield packed([(*key, digest.hexdigest())] if key is not None else [])

    order = [*NODE, "conv_id"]
    runs = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, made)
    runs = runs.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids")
    return runs.mapInArrow(digested, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, container: int = CONTAINER) -> DataFrame:
    """One row per distinct prefix of the conversations, the empty one included.

    ``turns`` has (conv_id, depth, id, bytes), depth from 1 without gaps; ``lengths`` has one row (conv_id, len) per
    conversation, len 0 for those without turns.  Columns: conv_id (smallest member), depth, parent_conv_id (null at the
    root), n_convs, n_children, n_leaves and saved_tokens over the subtree, ends_sha256.  Without a conversation there is no
    node.  Both tables are read more than once.
    """
    whole = lengths.agg(F.count(F.lit(1)), F.min("conv_id"), F.max("len")).first()
    spark = lengths.sparkSession
    if not whole[0]:
        return spark.createDataFrame([], NODES)
    rows = spread_join(turns, lengths.select("conv_id", "len"), "conv_id", ["depth"])
    rows = materialise(prefixes(rows, whole[2]), "prefixes")

    heads = rows.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.sum(F.col("len") - F.col("depth") + 1).alias("size"),
        F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    ).filter(F.col("size") > container)
    heads = materialise(heads, "heads")
    count = heads.count()
    small = F.broadcast(heads) if count <= BROADCAST_ROWS else heads
    flagged = rows.join(small.select(*NODE, F.lit(True).alias("head")), NODE, "left")
    flagged = materialise(flagged, "burst") if count else flagged

    below = flagged.filter("head is null")
    first = F.min_by(F.struct(*NODE, "p1", "p2"), "depth")
    containers = below.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("depth", "id", "bytes"))).alias("suffix"), first.alias("at"))
    inner = materialise(swept(containers.select("at.*", "conv_id", "suffix")), "containers")
    tops = inner.filter("top")

    root = spark.range(1).select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"),
        F.lit(whole[0]).cast("long").alias("n"), F.lit(whole[1]).cast("long").alias("least"),
        F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    heads = root.unionByName(heads.drop("size"))

    # children of heads, then the credits of every node to its smallest member
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = heads.filter("depth > 0").select(*parent).unionAll(tops.select(*parent))
    children = children.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    heads = heads.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own_leaf, own_saved = (F.col("n_children") == 0).cast("long"), (F.col("n") - 1) * F.col("bytes")
    credits = heads.select(F.col("least").alias("conv_id"), "depth", own_leaf.alias("leaf"), own_saved.alias("saved"))
    credits = credits.unionAll(tops.select("conv_id", "depth", "n_leaves", "saved_tokens"))
    through = flagged.filter("head").select("conv_id", *NODE)
    none = F.lit(0).cast("long")
    places = through.select("conv_id", *NODE, none.alias("leaf"), none.alias("saved"), F.lit(True).alias("node"))
    earned = credits.filter("depth > 0").select(
        "conv_id", "depth", none.alias("k1"), none.alias("k2"), "leaf", "saved", F.lit(False).alias("node"))
    add = lambda a, b: a + b
    summed = running(places.unionByName(earned), "conv_id", -F.col("depth"), {
        "leaves_below": (F.sum, F.col("leaf"), add), "saved_below": (F.sum, F.col("saved"), add)}, whole[2])
    sums = summed.filter("node").groupBy(*NODE).agg(F.sum("leaves_below").alias("n_leaves"), F.sum("saved_below").alias("saved_tokens"))
    total = credits.agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    sums = sums.unionByName(total.select(*[none.alias(c) for c in NODE], "n_leaves", "saved_tokens"))

    ended = flagged.filter("head and depth = len").select(*NODE, "conv_id")
    ended = ended.unionByName(lengths.filter("len = 0").select(*[none.alias(c) for c in NODE], "conv_id"))
    above = heads.select(F.col("least").alias("parent_conv_id"), *[F.col(c).alias(f"_{c}") for c in NODE])
    inside = (F.col("depth") - 1 == F.col("_depth")) & (F.col("p1") == F.col("_k1")) & (F.col("p2") == F.col("_k2"))
    upper = heads.join(sums, NODE).join(head_ends(ended), NODE, "left").join(above, inside, "left")
    upper = upper.withColumns({"conv_id": F.col("least"), "n_convs": F.col("n")})
    upper = upper.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(ends_digest([]))))
    tops = tops.drop("parent_conv_id").join(above, inside)
    return upper.select(*RESULT).unionByName(tops.select(*RESULT)).unionByName(inner.filter("not top").select(*RESULT))


# ---- the query ------------------------------------------------------------------------------------------------

FAMILY, MOST_TAKEN = 5, 8


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the first h turns of conversation c - c % 5 in place of its own first h.

    h is the CRC-32 of the decimal c modulo 9.  Returns turns (conv_id, depth, id, bytes) and lengths (conv_id, len).
    """
    placed = materialise(numbered(turns), "placed")
    c = F.col("conv_id")
    sizes = placed.groupBy("conv_id").agg(F.max("place").alias("size"))
    sizes = sizes.withColumns({"base": c - c % FAMILY, "h": F.crc32(c.cast("string").cast("binary")) % (MOST_TAKEN + 1)})
    bases = sizes.filter(c == F.col("base")).select("base", F.col("size").alias("_size"))
    sizes = sizes.join(bases, "base", "left")
    sizes = sizes.withColumn("taken", F.least("h", F.coalesce("_size", F.lit(0)))).drop("_size")
    sizes = materialise(sizes.withColumn("len", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))), "sizes")
    given = placed.filter((c % FAMILY == 0) & (F.col("place") <= MOST_TAKEN)).withColumnRenamed("conv_id", "base")
    given = sizes.select("conv_id", "base", "h").join(given, "base").filter("place <= h")
    own = spread_join(placed, sizes.select("conv_id", "h", "taken"), "conv_id", ["place"]).filter("place > h")
    depth = F.col("place") - F.col("h") + F.col("taken")
    turns = given.select("conv_id", F.col("place").alias("depth"), "id", "bytes").unionByName(
        own.select("conv_id", depth.alias("depth"), "id", "bytes"))
    return materialise(turns, "rebuilt"), sizes.select("conv_id", "len")


SQL = """
with plain as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations where conv_id is not null),
ids as (
  select conv_id, turn, sha256(strlen(r) || ':' || r || x) id, strlen(x)::bigint size from plain),
placed as (
  select conv_id c, id, size, row_number() over (partition by conv_id order by turn nulls first, id) place from ids),
sizes as (
  select c, max(place) size, c - c % 5 base,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda t, i: xor(t >> 1, 3988292384 * (t & 1)))), 4294967295::bigint) % 9 h
  from placed group by c),
taken as (
  select s.*, least(s.h, coalesce(b.size, 0)) taken from sizes s left join sizes b on b.c = s.base),
turns as (
  select t.c, p.place depth, p.id, p.size from taken t join placed p on p.c = t.base and p.place <= t.h
  union all
  select t.c, p.place - t.h + t.taken, p.id, p.size from taken t join placed p on p.c = t.c and p.place > t.h),
sequences as (
  select t.c, coalesce(list(u.id order by u.depth) filter (u.id is not null), []) ids,
    coalesce(list(u.size order by u.depth) filter (u.id is not null), []) sizes
  from taken t left join turns u using (c) group by t.c),
prefixes as (
  select c, ids, sizes, unnest(range(0, len(ids) + 1)) depth from sequences),
nodes as (
  select depth, list_slice(ids, 1, depth) node, min(c) least, count(*) n,
    coalesce(max(case when depth > 0 then sizes[depth] end), 0) size,
    coalesce(string_agg(c::varchar, ',' order by c) filter (len(ids) = depth), '') ends
  from prefixes group by all),
children as (
  select depth - 1 depth, list_slice(node, 1, depth - 1) node, count(*) n_children from nodes where depth > 0 group by all),
full_nodes as (
  select n.*, coalesce(n_children, 0) n_children from nodes n left join children using (depth, node)),
above as (
  select unnest(range(0, depth + 1)) up, node, (n_children = 0)::bigint leaf, (n - 1) * size saved from full_nodes),
sums as (
  select up depth, list_slice(node, 1, up) node, sum(leaf) n_leaves, sum(saved) saved from above group by all)
select f.least conv_id, f.depth, p.least parent_conv_id, f.n n_convs, f.n_children::bigint n_children,
  s.n_leaves::bigint n_leaves, s.saved::bigint saved_tokens, sha256(f.ends) ends_sha256
from full_nodes f join sums s using (depth, node)
left join nodes p on p.depth = f.depth - 1 and p.node = list_slice(f.node, 1, f.depth - 1) and f.depth > 0
"""


@register("op11_turn_trie", SQL)
def op11(spark, sf_dir):
    """The prefix trie of all rebuilt conversations."""
    turns, lengths = rebuilt(table(spark, sf_dir, "conversations"))
    return prefix_trie(turns, lengths)

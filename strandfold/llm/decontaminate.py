"""Benchmark decontamination with an Aho-Corasick automaton over normalised windows of benchmark items.

Words are runs of ASCII letters and digits and of anything beyond ASCII, with A-Z lower-cased.  A window is ``size``
consecutive words of an item, or all words of a shorter one.  Windows and documents are written as words between
single spaces, so that one scan of a document finds every window at word borders; hits are mapped back to word
numbers and to code points of the original text.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandfold.llm.common import append_arrow, register, table, without

# Lower-cases A-Z, keeps a-z, 0-9 and the bytes of non-ASCII characters, makes anything else a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")

HIT = "array<struct<first:int,last:int>>"
SPAN = "array<struct<start:int,end:int>>"


def fold(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def item_windows(text: str | None, size: int = 10) -> list[str]:
    """The windows of an item, words separated and enclosed by spaces, one character per UTF-8 byte."""
    words = fold(text)
    count = max(1, len(words) - size + 1) if words else 0
    return [(b" " + b" ".join(words[k : k + size]) + b" ").decode("latin-1") for k in range(count)]


def windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(pattern, item_ids) of all distinct windows; items with equal ids count as one, a null id is an empty list."""

    def make(batches):
        for texts in batches:
            yield ([sorted(set(item_windows(t, size))) for t in texts],)

    found = append_arrow(benchmark, {"patterns": "array<string>"}, make, ["item_id"])
    each = found.select(F.col("item_id").cast("string").alias("item_id"), F.explode("patterns").alias("pattern"))
    return each.groupBy("pattern").agg(F.collect_set("item_id").alias("item_ids"))


def shards(patterns: DataFrame, bound: int) -> list[list[tuple[str, list[str]]]]:
    """The windows in lists of about ``bound`` characters each; a shard is all that is broadcast at once."""
    weight = F.length("pattern") + F.aggregate("item_ids", F.lit(0), lambda s, x: s + F.length(x) + 8)
    total = patterns.agg(F.sum(weight)).first()[0] or 0
    count = max(1, -(-total // bound))
    numbered = patterns.withColumn("shard", F.pmod(F.xxhash64("pattern"), F.lit(count)))
    return [
        [(r.pattern, r.item_ids) for r in numbered.filter(F.col("shard") == k).collect()] for k in range(count)
    ]


_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def automaton(name: str, patterns: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    """The automaton of a broadcast shard, built once per worker process; only the last one is kept."""
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        machine = ahocorasick.Automaton()
        for pattern, items in patterns:
            machine.add_word(pattern, (pattern.count(" ") - 1, items))
        machine.make_automaton()
        _AUTOMATA[name] = machine
    return _AUTOMATA[name]


def scan(machine: ahocorasick.Automaton, text: str | None):
    """(number of words, runs of hit words as (first, last), items with occurring windows, spans in the text)."""
    words = fold(text)
    if not words or not len(machine):
        return len(words), [], set(), []
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = list(machine.iter(line))
    if not found:
        return len(words), [], set(), []
    ends = np.cumsum([len(w) + 1 for w in words])
    last = np.searchsorted(ends, [e for e, _ in found])
    items: set[str] = set()
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, last - np.array([n for _, (n, _) in found]) + 1, 1)
    np.add.at(edge, last + 1, -1)
    for ids in {id(v[1]): v[1] for _, v in found}.values():
        items.update(ids)
    runs = spans_of(np.cumsum(edge[:-1]) > 0)
    places = [m.span() for m in WORD.finditer(text)]
    return len(words), runs, items, [(places[a][0], places[b][1]) for a, b in runs]


def spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true flags as (first, last)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2])]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, bound: int = 4_000_000,
                  keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) plus n_words, n_hit, n_items, item_ids, hits, spans, contaminated.

    hits are runs of hit words, spans their code points in the original text.  A null or empty text has no words; an
    empty benchmark hits nothing; items without words have no window.  Items with a null id hit, but are not listed.
    The automaton holds at most about ``bound`` characters of windows; a larger benchmark is scanned shard by shard,
    and the runs and items of a document are merged as they come.  Clashing columns of ``docs`` are replaced.
    """
    names = ["n_words", "n_hit", "n_items", "item_ids", "hits", "spans", "contaminated"]
    docs = without(docs, *names)
    keep = docs.columns if keep is None else keep
    parts = shards(windows(benchmark, size), bound)
    context = docs.sparkSession.sparkContext
    out = docs
    for k, part in enumerate(parts):
        shared, name = context.broadcast(part), uuid.uuid4().hex

        def make(batches, shared=shared, name=name):
            machine = automaton(name, shared.value)
            for texts in batches:
                rows = [scan(machine, t) for t in texts]
                yield (
                    [r[0] for r in rows],
                    [[{"first": a, "last": b} for a, b in r[1]] for r in rows],
                    [sorted(r[2]) for r in rows],
                    [[{"start": a, "end": b} for a, b in r[3]] for r in rows],
                )

        columns = {"n_words": "long", f"_hits{k}": HIT, f"_items{k}": "array<string>", f"_spans{k}": SPAN}
        held = [f"_{what}{j}" for j in range(k) for what in ("hits", "items", "spans")]
        wanted = keep if k == len(parts) - 1 else [*docs.columns]
        out = append_arrow(out, columns, make, [*wanted, *held])
    every = range(len(parts))
    items = F.array_sort(F.array_distinct(F.concat(*[F.col(f"_items{k}") for k in every])))

    def merged(what: str, first: str, last: str, gap: int):
        if len(parts) == 1:
            return F.col(f"_{what}0")
        runs = F.array_sort(F.concat(*[F.col(f"_{what}{k}") for k in every]))
        empty = F.slice(runs, 1, 0)

        def add(done, run):
            tail = F.try_element_at(done, F.lit(-1))
            joins = (F.size(done) > 0) & (run[first] <= tail[last] + gap)
            longer = F.struct(tail[first].alias(first), F.greatest(tail[last], run[last]).alias(last))
            return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(
                F.concat(done, F.array(run)))

        return F.aggregate(runs, empty, add)

    out = out.select(
        *[F.col(f"`{c}`") for c in keep], "n_words", items.alias("item_ids"),
        merged("hits", "first", "last", 1).alias("hits"), merged("spans", "start", "end", 0).alias("spans"),
    )
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"] + 1)
    out = out.withColumn("n_hit", n_hit).withColumn("n_items", F.size("item_ids").cast("long"))
    out = out.withColumn("contaminated", F.col("n_hit") > 0)
    return out.select(*[F.col(f"`{c}`") for c in keep], *names)


SQL_TEXT = r"""
with w as (
  select 'd' side, doc_id::varchar id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws, doc_id from documents
  union all
  select 'b', item_id::varchar, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), null from benchmark),
items as (select id, least(len(ws), 10) n, unnest(range(1, greatest(2, len(ws) - 8))) k, ws from w
  where side = 'b' and len(ws) > 0),
pats as (select distinct id, n, array_to_string(ws[k:k + n - 1], ' ') p from items),
sizes as (select distinct n from pats),
docs as (select row_number() over () r, doc_id, ws from w where side = 'd'),
places as (select r, n, unnest(range(1, len(ws) - n + 2)) k, ws from docs, sizes where len(ws) >= n),
found as (select r, k, places.n, p.id from places join pats p
  on p.n = places.n and p.p = array_to_string(ws[k:k + places.n - 1], ' ')),
hit as (select r, count(distinct i) n_hit from (select r, unnest(range(k, k + n)) i from found) group by r),
its as (select r, count(*) n_items, string_agg(id, ',' order by id) s from (select distinct r, id from found)
  group by r)
select doc_id, len(coalesce(ws, [])) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from docs left join hit using (r) left join its using (r)
"""


@register("op1_decontaminate", SQL_TEXT)
def op1(spark, sf_dir):
    """Words of every document inside benchmark windows, and the items they come from."""
    docs = table(spark, sf_dir, "documents")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    digest = F.sha2(F.concat_ws(",", "item_ids"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")

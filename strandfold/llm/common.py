"""Helpers shared by the corpus operators: query registry, tables, recoverable intermediates, components."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandfold.session import materialise, release, tune  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TEXT = "text"


def register(name: str, sql: str | None = None):
    """Add a query; without ``sql`` SQL cannot express it and it is tested against brute force."""

    def add(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(tune(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = query.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add; its own results win over clashing names."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


KEPT = "kept#"


def set_aside(*used: str):
    """Decorator of an operator on a table: its own working columns cannot clash with columns of the caller.

    The operator gets the columns ``used`` (those that are there) and all others packed into one.  What it adds comes last,
    and replaces columns of the same name; with ``keep`` only those columns of the caller come back.
    """

    def decorate(operator):
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, keep: list[str] | None = None, **options) -> DataFrame:
            there = [c for c in docs.columns if c.lower() in used]
            wanted = docs.columns if keep is None else keep
            others = [c for c in wanted if c not in there]
            packed = docs.select(
                *[F.col(f"`{c}`") for c in there], *([F.struct(*[F.col(f"`{c}`") for c in others]).alias(KEPT)] if others else []))
            inner = [c for c in packed.columns if c in wanted or c == KEPT]
            passed = {} if keep is None and inner == packed.columns else {"keep": inner}
            made = operator(packed, *args, **passed, **options)
            added = [c for c in made.columns if c not in packed.columns]
            names = {c.lower() for c in added}
            shown = [c for c in wanted if c.lower() not in names]
            return made.select(
                *[(F.col(f"`{KEPT}`")[c] if c in others else F.col(f"`{c}`")).alias(c) for c in shown],
                *[F.col(f"`{c}`") for c in added])

        return run

    return decorate


def append_arrow(df: DataFrame, columns: dict[str, str], make, keep: list[str] | None = None, text: str = TEXT) -> DataFrame:
    """``df`` (or its columns ``keep``) plus new columns computed from column ``text`` batch by batch.

    ``make(batches)`` maps an iterator of lists of texts (None for null) to an iterator of lists of column
    values, in the order of ``columns`` (name: Spark type).  Other columns pass through untouched.
    """
    base = without(df, *columns)
    kept = base.columns if keep is None else keep
    schema = base.select(*[F.col(f"`{c}`") for c in kept]).schema
    for name, kind in columns.items():
        schema = schema.add(name, T.StructType.fromDDL(f"x {kind}")["x"].dataType)
    needed = list(dict.fromkeys([*kept, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts():
            for batch in batches:
                held.append(batch)
                yield batch.column(needed.index(text)).to_pylist()

        target = to_arrow_schema(schema)
        for made in make(texts()):
            batch = held.pop()
            arrays = [batch.column(needed.index(c)).cast(target.field(k).type) for k, c in enumerate(kept)]
            arrays += [pa.array(v, target.field(len(kept) + k).type) for k, v in enumerate(made)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return base.select(*[F.col(f"`{c}`") for c in needed]).mapInArrow(run, schema)


def top_ids(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most ``rows`` key tuples, picked by the hash of the keys: a bounded sample that reruns repeat."""
    order = F.xxhash64(*keys)
    return df.select(*keys).distinct().orderBy(order, *keys).limit(rows)


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links: rows (node, component), component = smallest node reached.

    Alternates two steps on the link table: every node's larger neighbours move to its smallest neighbour,
    then its smaller neighbours do.  Rows never exceed the number of links, every step is an aggregation with
    map-side combine plus a join that adaptive execution can split, and each round is written to the shared
    folder.  Nodes without a link are absent; self links and nulls are ignored.  Ends when nothing changes.
    """
    x, y = F.col(a), F.col(b)
    links = links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).filter("u <> v").distinct()
    links = materialise(links, "links")

    def seal(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = seal(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        ).select("col.u", "col.v")
        former, links = links, materialise(small.filter("u <> v").distinct(), "links")
        release(former)
        after = seal(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

"""Joins that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_SPLIT = 20_000
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class HotKeys:
    """Keys with too many rows for one task and the number of splits of each: (key, splits)."""

    table: DataFrame
    count: int

    def small(self) -> DataFrame:
        """The table, broadcast only if its counted size allows it."""
        return F.broadcast(self.table) if self.count <= BROADCAST_ROWS else self.table


def hot_keys(keys: DataFrame, rows_per_split: int = ROWS_PER_SPLIT) -> HotKeys:
    """Count the rows per key of a one-column table (``key``) and pick the hot ones.

    One partial + final aggregation over the key column alone; it runs at once, because whether there
    are hot keys decides the shape of the join.
    """
    rows = keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > rows_per_split)
    table = rows.select("key", F.ceil(F.col("rows") / rows_per_split).cast("int").alias("splits"))
    return HotKeys(table, table.count())


def spread_join(
    many: DataFrame, one: DataFrame, key: str, row_key: list[str], hot: HotKeys | None = None
) -> DataFrame:
    """Inner join of ``many`` with a table that has one (possibly wide) row per ``key``.

    Rows of a hot key are salted by ``row_key`` and only the row of that key in ``one`` is copied,
    once per split; other keys are untouched, and without hot keys this is a plain equi-join.
    ``many`` is also read for the count, so it should be cheap or materialised.
    """
    hot = hot_keys(many.select(F.col(key).alias("key"))) if hot is None else hot
    if hot.count == 0:
        return many.join(one, key)
    splits = hot.small().withColumnRenamed("key", key)
    salt: Column = F.pmod(F.xxhash64(*row_key), F.coalesce("splits", F.lit(1))).cast("int")
    salted = many.join(splits, key, "left").withColumn("_salt", salt).drop("splits")
    copies = one.join(splits, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1))
    ).drop("splits")
    return salted.join(copies, [key, "_salt"]).drop("_salt")

"""Named queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandfold.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Add a query; without ``sql`` it has no equivalent that SQL can run on whole tables."""

    def add(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(query(tune(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = query.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return query

    return add


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Plain result types: integers as bigint, doubles rounded and without negative zero."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            column = column.cast("long")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, digits) + F.lit(0.0)
        out.append(column.alias(field.name))
    return df.select(*out)

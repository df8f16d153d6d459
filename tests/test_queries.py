"""Registered queries against their SQL, on parts of the smallest tables; on all of them with STRANDFOLD_FULL=1."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_point

FULL = os.environ.get("STRANDFOLD_FULL") == "1"
# Queries of the corpus subpackage have their own tests.
CORE = sorted(n for n in entry_point.oracle_sql() if n != "pipeline" and not re.match(r"op\d+_", n))


@pytest.fixture(scope="module")
def tables(small, tmp_path_factory):
    """The smallest tables, or parts of them that keep their peculiarities: neighbouring ids, all lines of some suppliers."""
    if FULL:
        return small
    folder = tmp_path_factory.mktemp("tables")
    parts = {"embeddings": "where vec_id < 45", "lineitem": "where l_suppkey < 6", "events": "where user_id < 20", "documents": "limit 50"}
    for path in glob.glob(f"{small}/*.parquet"):
        name = os.path.basename(path)[:-8]
        duckdb.sql(f"copy (select * from '{path}' {parts.get(name, '')}) to '{folder}/{name}.parquet'")
    return str(folder)


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for path in glob.glob(f"{tables}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(r[k] for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, tables, duck, name):
    df = entry_point.queries()[name](spark, tables)
    cursor = duck.execute(entry_point.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())


def test_statistics_do_not_depend_on_batches(spark, small):
    from strandfold.operators.score import alignment_stats
    from strandfold.plans.catalog_geometry import given_points

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, found = spark.conf.get(key), []
    for size in (7, 64, 512):
        spark.conf.set(key, size)
        rows = alignment_stats(given_points(spark, small, "right"), ["pair_id"]).collect()
        found.append({r.pair_id: (r.n, r.gaps, round(r.rmsd, 9), round(r.max_dist, 9)) for r in rows})
        assert len(rows) == len(found[0])
    spark.conf.set(key, before)
    assert found[0] == found[1] == found[2]


def test_every_sql_belongs_to_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry_has_five_rows_per_pair(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["pair_id", "i0", "j0", "frag_rmsd", "place"]
    assert df.count() == 5 * 499

"""Tasks of steps whose exchanges have few bytes follow the number of rows that they make."""

import pytest
from pyspark.sql import functions as F

from strandfold import session
from strandfold.plans import bridge, catalog_compare


@pytest.fixture
def tables(spark, tmp_path):
    vectors = spark.range(3000).select(
        F.col("id").alias("vec_id"), F.lit("A").alias("label"),
        F.transform(F.sequence(F.lit(1), F.lit(63)), lambda k: ((k * 7 + F.col("id")) % 11).cast("float")).alias("embedding"))
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    lines = spark.range(30000).select(
        (F.col("id") % 40).alias("l_suppkey"), (F.col("id") * 7).alias("l_partkey"), (F.col("id") % 50).alias("l_quantity"),
        F.when(F.col("id") % 2 == 0, "O").otherwise("F").alias("l_linestatus"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def largest(df):
    sizes = df.groupBy(F.spark_partition_id().alias("p")).count()
    return sizes.agg(F.max("count")).first()[0]


def test_matches_are_dealt_by_their_number(spark, tables, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 5000)
    monkeypatch.setattr(session, "task_count", lambda spark: 1)
    matches = bridge.given_matches(spark, tables, "left")
    assert matches.count() > 40000 and largest(matches) < 3000
    sets = bridge.match_sets(spark, tables, "O")
    assert largest(sets) < 5000 and sets.count() == sets.distinct().count()
    for query in (catalog_compare.compare_alignments, catalog_compare.same_alignment):
        assert query(spark, tables).count() == 2999
    assert catalog_compare.pair_overlap_large(spark, tables).agg(F.sum("n_left")).first()[0] == sets.count()

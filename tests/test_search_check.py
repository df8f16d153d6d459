"""The checks of a whole search and of solved winners run each search once."""

import pytest
from pyspark.sql import functions as F

from strandfold.plans import catalog_align


def test_whole_search_is_written_before_its_check(spark, monkeypatch):
    found = []
    monkeypatch.setattr(catalog_align, "paired", lambda spark, sf: spark.range(1))
    monkeypatch.setattr(catalog_align.search, "best_solutions", lambda chains, wanted: chains.withColumn("found", F.lit(1)))
    monkeypatch.setattr(catalog_align, "cut_lineage", lambda df: found.append(df.columns) or df)

    class Stop(Exception):
        pass

    def consistent(*args):
        raise Stop

    monkeypatch.setattr(catalog_align, "consistent", consistent)
    with pytest.raises(Stop):
        catalog_align.search_best_checked(spark, "")
    assert found == [["id"], ["id", "found"]]


def test_winners_are_written_before_and_after_they_are_solved(spark, monkeypatch):
    found = []
    ranked = spark.range(1).withColumn("rank", F.lit(1))
    monkeypatch.setattr(catalog_align, "interval_alternatives", lambda spark, sf: (None, None, ranked))
    monkeypatch.setattr(catalog_align.A, "winners_solved", lambda winners, *args: winners.withColumn("solved", F.lit(1)))
    monkeypatch.setattr(catalog_align, "cut_lineage", lambda df: found.append(df.columns) or df)

    class Stop(Exception):
        pass

    def consistent(*args):
        raise Stop

    monkeypatch.setattr(catalog_align, "consistent", consistent)
    with pytest.raises(Stop):
        catalog_align.alternatives_solved(spark, "")
    assert found == [["id", "rank"], ["id", "rank", "solved"]]

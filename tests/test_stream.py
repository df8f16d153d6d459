"""The best-so-far table over several batches, restarts, replays and without input."""

import os
import random

import pytest
from pyspark.sql import functions as F

from strandfold.streaming import best

SCHEMA = "pair_id long, n int, o_id long, ssd double"


def candidates(seed, rows=80):
    r = random.Random(seed)
    return [(r.randint(0, 3), r.randint(2, 5), r.randint(0, 999), round(r.random(), 3)) for _ in range(rows)]


def expected(rows):
    out = {}
    for pair, n, o, ssd in rows:
        out[pair, n] = min(out.get((pair, n), (9.0, 0)), (ssd, o))
    return sorted((*k, *v) for k, v in out.items())


def shown(df):
    return sorted((r.pair_id, r.n, r.ssd, r.o_id) for r in df.collect())


@pytest.fixture
def folders(tmp_path):
    return [str(tmp_path / name) for name in ("in", "table", "state")]


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_batches_restarts_and_folds(spark, folders):
    source, table, state = folders
    rows = []
    for part in range(3):
        for k in range(4):
            new = candidates(10 * part + k)
            rows += new
            spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        made = best.run_best(stream(spark, source), table, state, fold_every=2)
        assert shown(made) == expected(rows)
    kept = [n for n in os.listdir(table) if not n.startswith(".")]
    assert len([n for n in kept if n.startswith("base=")]) <= 2 and len(kept) <= 6


def test_epochs_can_run_again(spark, folders):
    table, rows = folders[1], []
    for epoch in range(7):
        new = candidates(epoch, 20)
        rows += new
        batch = spark.createDataFrame(new, SCHEMA)
        for _ in range(2):
            best.add_epoch(best.stream_best(batch), epoch, table, fold_every=3)
            assert shown(best.read_best(spark, table)) == expected(rows)


def test_a_fold_that_did_not_finish_counts_for_nothing(spark, folders):
    table = folders[1]
    batch = spark.createDataFrame(candidates(1), SCHEMA)
    best.add_epoch(best.stream_best(batch), 0, table)
    half = best.stream_best(batch).withColumn("ssd", F.lit(-1.0))
    half.write.parquet(f"{table}/base=0")
    os.remove(f"{table}/base=0/_SUCCESS")
    assert shown(best.read_best(spark, table)) == expected(candidates(1))


def test_no_input(spark, folders):
    source, table, state = folders
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    assert best.run_best(stream(spark, source), table, state).count() == 0
    assert best.read_best(spark, table + "-none").columns == ["pair_id", "n", "ssd", "o_id"]

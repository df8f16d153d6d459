"""The best-so-far table while candidates arrive.

The stream keeps one row of state per pair and match count and passes on what improves.  The table is a folder of epochs
(``delta=<epoch>``), folded from time to time into one keyed table (``base=<epoch>``), so neither its size nor the
number of its folders grows with the number of epochs.  Every step can run again: an epoch overwrites itself, and a fold reads
the base before it, which stays until the next fold is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "pair_id bigint, n int, ssd double, o_id bigint"
FOLD_EVERY = 8


def stream_best(candidates: DataFrame) -> DataFrame:
    """Streaming form of best_per_n: state is one row per pair and match count."""
    row = F.struct(F.col("ssd"), F.col("o_id"))
    return candidates.groupBy("pair_id", "n").agg(F.min(row).alias("r")).select(
        "pair_id", "n", F.col("r.ssd").alias("ssd"), F.col("r.o_id").alias("o_id")
    )


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _epochs(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Epochs of the finished folders of one kind, in order."""
    files, where = _folder(spark, path)
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    found = [n for n in names if n.startswith(f"{kind}=")]
    done = [n for n in found if files.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[1])]
    return sorted(int(n.split("=")[1]) for n in done)


def _drop(spark: SparkSession, path: str) -> None:
    files, where = _folder(spark, path)
    files.delete(where, True)


def read_best(spark: SparkSession, path: str, until: int | None = None) -> DataFrame:
    """The table (pair_id, n, ssd, o_id) as of the last finished epoch, or of epoch ``until``; empty before the first."""
    bases = [e for e in _epochs(spark, path, "base") if until is None or e < until]
    start = bases[-1] if bases else -1
    deltas = [e for e in _epochs(spark, path, "delta") if e > start and (until is None or e <= until)]
    parts = [f"{path}/base={start}"] * bool(bases) + [f"{path}/delta={e}" for e in deltas]
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    return stream_best(spark.read.schema(SCHEMA).parquet(*parts))


def add_epoch(batch: DataFrame, epoch: int, path: str, fold_every: int = FOLD_EVERY) -> None:
    """Write what an epoch improves, and fold the table every ``fold_every`` epochs.

    A fold drops the base before the one it started from, and the epochs that base covers.
    """
    spark = batch.sparkSession
    batch.select("pair_id", F.col("n").cast("int").alias("n"), "ssd", "o_id").write.mode("overwrite").parquet(f"{path}/delta={epoch}")
    if (epoch + 1) % fold_every:
        return
    before = [e for e in _epochs(spark, path, "base") if e < epoch]
    read_best(spark, path, epoch).write.mode("overwrite").parquet(f"{path}/base={epoch}")
    if before:
        for kind, last in (("base", before[-1] - 1), ("delta", before[-1])):
            for e in _epochs(spark, path, kind):
                if e <= last:
                    _drop(spark, f"{path}/{kind}={e}")


def run_best(candidates: DataFrame, out_path: str, state_path: str, fold_every: int = FOLD_EVERY) -> DataFrame:
    """Drain the available input and return the table; run again with the same paths, it goes on where it ended."""
    query = (
        stream_best(candidates).writeStream.outputMode("update")
        .foreachBatch(lambda batch, epoch: add_epoch(batch, epoch, out_path, fold_every))
        .option("checkpointLocation", state_path).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return read_best(candidates.sparkSession, out_path)

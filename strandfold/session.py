"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Session-level SQL settings the operators are written for.  Small Arrow batches matter because one
# row of an orientation block already carries hundreds of matrices.  The method limit is the size above
# which the JVM no longer compiles a method: larger fused stages fall back to per-operator code.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, wherever it was imported from.

    The archive is only staged on the driver; Spark hands it to every executor.
    """
    context = spark.sparkContext
    if getattr(context, "_strandfold_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="strandfold-")) / "strandfold.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._strandfold_shipped = True


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session and make the package known to its workers."""
    ship_package(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    # On one machine the default of 200 shuffle partitions only costs time (state stores most of all).
    local = spark.sparkContext.master.startswith("local")
    if local and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


def local_session(app: str = "strandfold", cpus: str | int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a fresh temporary folder; on a cluster a missing setting is
    an error, because a machine-local folder would not survive the loss of that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="strandfold-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder of the session and read it back.

    The files survive the loss of executors, and later steps read them instead of running the plan again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.scratch = path
    return made


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no later plan reads; what was made of them must have been written."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage so later rounds do not recompute it."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def task_count(spark: SparkSession) -> int:
    """Partitions for CPU-heavy steps, whose cost has nothing to do with their bytes.

    Three per core of the cluster unless ``spark.strandfold.tasks`` says otherwise.  An explicit
    number keeps AQE from merging many small-but-expensive partitions into one task.
    """
    wanted = spark.conf.get("spark.strandfold.tasks", None)
    return int(wanted) if wanted else 3 * spark.sparkContext.defaultParallelism


# Rows of one task in aggregations that hold every row in memory, some 100 MB for each hash table.
ROWS_PER_TASK = 500_000


def tasks_for_rows(spark: SparkSession, rows: int | None) -> int:
    """Partitions for a step that makes ``rows`` rows, so that a task's share does not grow with the input.

    For exchanges whose bytes say little about what follows: ids that become many rows, or rows that compress well.
    """
    return max(task_count(spark), (rows or 0) // ROWS_PER_TASK + 1)

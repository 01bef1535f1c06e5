"""Session defaults. Everything here is a plain Spark setting and can be overridden."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


#: A side of a join with at most so many rows is sent to every task.
FEW = 100_000
#: So many rows of a join's larger side go to a task.
ROWS_A_TASK = 500_000
#: So many rows that a join makes and does not keep are returned by a task.
ROWS_RETURNED = 4_000_000


def local_session(cores: int | None = None, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cores}]").appName("flankline")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set, one machine (a local master) makes a temporary one and a cluster
    fails: executors would not see each other's files."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context.getCheckpointDir()
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="flankline-")
            context.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """``df``, written to the checkpoint folder and read back: later plans know the size of its files. A ``checkpoint()`` keeps the
    size that its plan guessed, and the guess for a join is a product: in a loop of joins that number has as many digits as 2 to the rounds."""
    path = f"{checkpoint_folder(df.sparkSession)}/flankline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joining(side: DataFrame, n: int) -> DataFrame:
    """The side of a join that has ``n`` rows: sent to every task if they are few, else sorted and merged, whatever the size of its
    files: small files may hold very many rows, and what is sent to every task passes through the driver."""
    return F.broadcast(side) if n <= FEW else side.hint("merge")


def tasks_for(spark: SparkSession, n: int) -> int:
    """The number of partitions for ``n`` rows that tasks sort or keep in hash tables: ``ROWS_A_TASK`` of them in each, so that what a
    task holds does not grow with the input. Adaptive execution does not merge partitions whose number is asked for; it would by the
    bytes that were sent, and many rows that are alike are few bytes. Both sides of a join are to ask for the same number."""
    return max(spark.sparkContext.defaultParallelism, -(-n // ROWS_A_TASK))


def tasks_returning(spark: SparkSession, n: int) -> int:
    """The number of partitions for ``n`` rows that a join makes of far fewer: ``ROWS_A_TASK`` in each until all cores have work, then
    ``ROWS_RETURNED``, as such rows pass through a task and each task writes a file."""
    return max(1, min(spark.sparkContext.defaultParallelism, -(-n // ROWS_A_TASK)), -(-n // ROWS_RETURNED))

"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | None = None, **extra: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    n = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName("molinete")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is only made up in local mode, where the driver and
    the executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="molinete-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


_SCRATCH: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder below the checkpoint folder that takes all tables written by :func:`durable` inside the block and goes with it.

    Results must be consumed (written, counted) before the block ends, as they may read what was written.
    """
    path = f"{checkpoint_folder(spark)}/scratch-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    try:
        yield path
    finally:
        _SCRATCH.remove(path)
        remove(spark, path)


def work_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the innermost :func:`scratch` folder, else the checkpoint folder."""
    return _SCRATCH[-1] if _SCRATCH else checkpoint_folder(spark)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written, on whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written table.

    Used between the rounds of an iterative job and where a result must not be
    worked out twice: a lost executor costs a re-read, not a replay of all earlier
    rounds. A written table also starts the next plan afresh, with its true size and
    none of the constraints that ``checkpoint()`` carries along and multiplies. Inside :func:`scratch` it goes with the block.
    """
    path = f"{work_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Session helpers: a session for tests and benches, and reliable checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "plumbline") -> SparkSession:
    """A local session with the settings that tests and benches share."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PLUMBLINE_DRIVER_MEMORY", "6g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; only a local master may fall back to its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read again.

    Its files outlive any executor, and the plan that follows knows their true size (a checkpoint
    would carry on the estimate of the plan that made it, which grows with every join).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/plumbline-{uuid.uuid4().hex}"
    for folders in _open:
        folders.append(folder)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Folders written within each open ``temporary_tables``.
_open: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``cut_lineage`` wrote within it; results must be written or collected by then."""
    folders: list[str] = []
    _open.append(folders)
    try:
        yield
    finally:
        _open[:] = [f for f in _open if f is not folders]
        for folder in folders:
            drop_folder(spark, folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the session's file systems; one that does not exist is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    For work that is heavy per row: a few small files would otherwise keep most cores idle. Input
    of as many files or splits as cores, as any large one has, is returned as it is, without a
    shuffle. Only the plan's files and size are looked at; nothing is executed.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    return df if size >= cores * split else df.repartition(cores)

"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    A machine-local folder is only ever chosen in local mode, where driver and
    tasks share one machine; on a cluster an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    folder = getattr(spark, "_codeprep_checkpoint_dir", None)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="codeprep-checkpoint-")
        spark._codeprep_checkpoint_dir = folder
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the checkpoint folder that no other run uses."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _OPEN_JOBS:
        made.append(path)
    return path


# Paths made so far by the jobs that are running, innermost last.
_OPEN_JOBS: list[list[str]] = []


@contextlib.contextmanager
def job_scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the scratch tables that the job inside has made, once it has ended.

    For jobs whose results are written tables: a result that still reads scratch tables
    must not leave the block.
    """
    made: list[str] = []
    _OPEN_JOBS.append(made)
    try:
        yield
    finally:
        _OPEN_JOBS.remove(made)
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lies."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Used where one result feeds several later steps, so that a lost executor
    costs a re-read of files instead of a recomputation of the joins behind them. The
    shuffles behind the table are removed once it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def staged_rows(df: DataFrame, name: str, file: str = "_file", row: str = "_row") -> DataFrame:
    """``df`` from a written table, each row with its file and place, the same on every retry."""
    return placed(staged(df, name), file, row)


def placed(table: DataFrame, file: str, row: str) -> DataFrame:
    """A Parquet table with each row's file and place in it, which identify the row."""
    return table.select(
        "*",
        F.col("_metadata.file_path").alias(file),
        F.col("_metadata.row_index").alias(row),
    )


def shuffles(df: DataFrame) -> bool:
    """Whether the plan of a frame moves rows; asking such a one for its partitions runs it."""
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows over all cores before costly work on each, if the scan feeds fewer tasks.

    A table in a single row group is one task whatever the split size. Tables that ingest
    has written lie in many files and are left as they are, and so are large ones. What
    comes from a join or an aggregate is dealt already and left alone. Rows are dealt by a hash of ``keys`` where there are any.
    """
    if shuffles(df):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df

"""Written tables between the steps of an operator, and names that clash with no column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from codeprep.staging import scratch_path

# Set while a table is written: shuffles behind it go when it is there, and Python workers
# get texts in batches that stay small.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Rows of a folder come from one task: they need no sort before they are written.
    "spark.sql.maxConcurrentOutputFileWriters": "4",
}


def stage(
    df: DataFrame,
    name: str,
    path: str | None = None,
    folders: str | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder (or ``path``) and go on from the files.

    The files replace the shuffles behind them, so those are removed when the write has
    ended: an operator of several steps holds the shuffles of one step at a time.
    ``folders`` names a column with a folder for each value, ``options`` goes to the writer.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    before = {key: spark.conf.get(key) for key in WRITING}
    try:
        for key, value in WRITING.items():
            spark.conf.set(key, value)
        writer = df.write.mode("overwrite").option("compression", "zstd").options(**options or {})
        (writer.partitionBy(folders) if folders else writer).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands texts to Python in batches that stay small.

    For operators whose last step hands whole rows to Python when the caller runs it; how
    many rows a batch has changes no result.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > int(WRITING[key]):
        spark.conf.set(key, WRITING[key])


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, lengthened until it is no column of the table, in any case."""
    names = {c.lower() for c in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted

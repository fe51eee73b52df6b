"""The written fact table, one folder per split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeprep.config import DatasetVersion, dataset_version, split_name
from codeprep.sources.paths import require, under


def fact_path(out_dir: str, version: str | DatasetVersion) -> str:
    return under(out_dir, f"{dataset_version(version).database}/processed_data")


def write_fact(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """``overwrite=False`` leaves a table that is already there untouched."""
    mode = "overwrite" if overwrite else "ignore"
    df.write.mode(mode).option("compression", "zstd").partitionBy("split").parquet(path)


def read_fact(
    spark: SparkSession, out_dir: str, version: str | DatasetVersion, split: str | None = None
) -> DataFrame:
    """All rows with their split label, or one split, which reads that split's files only."""
    df = spark.read.parquet(require(spark, fact_path(out_dir, version)))
    return df if split is None else one_split(df, split)


def one_split(df: DataFrame, split: str) -> DataFrame:
    return df.filter(F.col("split") == split_name(split))

"""Token tables, one folder per split, rows numbered from 0 within each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeprep.config import DatasetVersion, dataset_version
from codeprep.operators.tokens import TOKEN_COLUMNS
from codeprep.sources.facts import one_split
from codeprep.sources.paths import require, under


def token_path(out_dir: str, version: str | DatasetVersion) -> str:
    return under(out_dir, f"{dataset_version(version).database}/tokens")


def vocabulary_path(out_dir: str, version: str | DatasetVersion) -> str:
    return under(out_dir, f"{dataset_version(version).database}/vocabulary")


def write_tokens(df: DataFrame, path: str) -> None:
    """Replace the token table; ``df`` has ``split``, ``id`` and the three arrays."""
    columns = df.select("split", "id", *TOKEN_COLUMNS)
    columns.write.mode("overwrite").partitionBy("split").parquet(path)


def read_tokens(
    spark: SparkSession, out_dir: str, version: str | DatasetVersion, split: str = "train"
) -> DataFrame:
    """One split in id order."""
    tokens = spark.read.parquet(require(spark, token_path(out_dir, version)))
    return one_split(tokens, split).select("id", *TOKEN_COLUMNS).orderBy("id")

"""Train, validation and test splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeprep.operators.numbering import number_shuffled

SPLITS = ("train", "val", "test")


def normalised_ratios(train: float, val: float, test: float) -> tuple[float, float, float]:
    """Scale the three shares so that they sum to one."""
    total = train + val + test
    if total <= 0:
        raise ValueError("split shares must sum to more than zero")
    return train / total, val / total, test / total


def checked_ratios(train: float, val: float, test: float) -> tuple[float, float, float]:
    """Accept only shares that already sum to one."""
    if abs(train + val + test - 1.0) > 1e-10:
        raise ValueError("the three shares of a split have to add up to 1")
    return train, val, test


def split_label(rank: Column, rows: Column, train: float, val: float) -> Column:
    """Label by rank from 1: the train share, the validation share, and the rest for test."""
    train_rows = (rows * F.lit(train)).cast("bigint")
    val_rows = (rows * F.lit(val)).cast("bigint")
    return (
        F.when(rank <= train_rows, "train")
        .when(rank <= train_rows + val_rows, "val")
        .otherwise("test")
    )


def split_sequential(
    numbered: DataFrame,
    train: float = 0.8,
    val: float = 0.1,
    test: float = 0.1,
    rank: str = "row_id",
    rows: str = "n_rows",
) -> DataFrame:
    """Add ``split`` by row number; ``rows`` is the column that holds the table's row count."""
    train, val, _ = normalised_ratios(train, val, test)
    return numbered.withColumn("split", split_label(F.col(rank), F.col(rows), train, val))


def split_shuffled(
    df: DataFrame,
    ident: str = "row_id",
    train: float = 0.8,
    val: float = 0.1,
    test: float = 0.1,
    seed: float | int = 42,
) -> DataFrame:
    """Add ``split`` with exact sizes by a random order of the unique ``ident``."""
    train, val, _ = checked_ratios(train, val, test)
    ranked = number_shuffled(df, ident, seed, "_place", total="_rows")
    label = split_label(F.col("_place"), F.col("_rows"), train, val)
    return ranked.withColumn("split", label).drop("_place", "_rows")


def split_keys(df: DataFrame) -> dict[str, DataFrame]:
    """Row ids of each split."""
    return {s: df.filter(F.col("split") == s).select("row_id") for s in SPLITS}


def rebuild_split(fact: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the fact table that one key table names."""
    return fact.join(keys, "row_id", "left_semi")


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """All splits under each other, each with its label."""
    labelled = [df.withColumn("split", F.lit(name)) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, labelled)


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))

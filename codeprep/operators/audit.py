"""Row counts and checks along the job."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """One row per stage with its row count, in one query."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
        for name, df in stages.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def split_counts(fact: DataFrame, usable: Column) -> DataFrame:
    """Rows of the fact table, of each split, and of usable examples, in one pass over it."""
    stages = {
        "processed_data": F.lit(True),
        "train": F.col("split") == "train",
        "val": F.col("split") == "val",
        "test": F.col("split") == "test",
        "examples": usable,
    }
    counts = fact.agg(*[F.count_if(rule).alias(name) for name, rule in stages.items()])
    rows = [F.struct(F.lit(s).alias("stage"), F.col(s).alias("n_rows")) for s in stages]
    return counts.select(F.inline(F.array(*rows)))


def require_unique(df: DataFrame, keys: Sequence[str], table: str) -> None:
    """Raise when a key occurs twice, which would multiply rows in the fact table."""
    twice = df.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).collect()
    if twice:
        found = ", ".join(f"{k}={twice[0][k]}" for k in keys)
        raise ValueError(f"{table} has more than one row for {found}")

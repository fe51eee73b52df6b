"""Equi-joins that stay even when one key holds a large share of the left rows.

Adaptive execution splits skewed partitions only where a shuffle feeds the join directly.
Here the right side is mostly the output of an aggregation on the same keys, so the split
is made explicit. A key with more than ``rows_per_task`` left rows gets a number of salts:
its left rows are dealt out over them, and its right rows are repeated once per salt. All
other keys keep the single salt 0. Salts change where rows meet, never which rows meet.
Left rows should be narrow (keys and a few values): a text joins later, by a unique key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "_salt"
ROWS_PER_TASK = 2_000_000
MISSING_KEY_SALTS = 4_096


def hot_keys(df: DataFrame, on: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with too many rows for one task, and over how many salts to spread them.

    Counts are combined on the map side. There is at most one such key per
    ``rows_per_task`` rows (50,000 for 100 billion), so the table is sent along. Stage it
    where several steps use it: otherwise each counts again.
    """
    return (
        df.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_task)
        .select(*on, F.ceil(F.col("_n") / F.lit(rows_per_task)).cast("int").alias("_salts"))
    )


def dealt(
    df: DataFrame, on: Sequence[str], hot: DataFrame, spread_by: Sequence[str]
) -> DataFrame:
    """Left side: a salt per row from a hash of ``spread_by``, a unique key of ``df``.

    Rows with a missing key match nothing, so they are dealt out freely.
    """
    missing = reduce(Column.__or__, [F.col(k).isNull() for k in on])
    lots = F.when(missing, F.lit(MISSING_KEY_SALTS)).otherwise(
        F.coalesce(F.col("_salts"), F.lit(1))
    )
    return (
        df.join(F.broadcast(hot), list(on), "left")
        .withColumn(SALT, F.pmod(F.xxhash64(*spread_by), lots.cast("bigint")).cast("int"))
        .drop("_salts")
    )


def copied(df: DataFrame, on: Sequence[str], hot: DataFrame) -> DataFrame:
    """Right side: every row of a hot key once per salt, all others once."""
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    return (
        df.join(F.broadcast(hot), list(on), "left")
        .withColumn(SALT, F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )


def skew_safe_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread_by: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Inner or left join of ``left`` to ``right`` with the hot keys of ``left`` spread out.

    ``hot`` is the table of ``hot_keys`` where it is known already.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    if how == "inner":
        left = left.dropna(subset=list(on))
    if hot is None:
        hot = hot_keys(left, on, rows_per_task)
    return (
        dealt(left, on, hot, spread_by)
        .join(copied(right, on, hot), [*on, SALT], how)
        .drop(SALT)
    )

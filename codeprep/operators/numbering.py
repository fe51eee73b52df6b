"""Gap-free row numbers without sorting the whole table in one task.

The rows are dealt out by ranges of their sort keys, sorted within each range and written,
one file per range. A row's number is then the row count of the files before its own plus
its place in the file: one shuffle, no window, and no bucket bounds to choose. Spark samples
the keys for the ranges in proportion to their number, and the number of ranges follows the
session's shuffle partitions, which ``session.recommended_settings`` sizes by the data.

Only the table of file sizes is summed up in one task: one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeprep.staging import placed, staged

FILE, ROW = "_file", "_row"


def number_placed(
    df: DataFrame, out: str, start: int = 1, total: str | None = None
) -> DataFrame:
    """Number rows that carry their file and place in it, in file order.

    Files are ordered by the number of the task that wrote them, then by name. The sizes are
    one row per file and are sent along; else whole rows would be shuffled by their file.
    """
    part = F.regexp_extract(FILE, r"part-(\d+)[^/]*$", 1).try_cast("bigint")
    sizes = df.groupBy(FILE).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy(part, FILE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        FILE,
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy()).alias("_total"),
    )
    numbered = df.join(F.broadcast(offsets), FILE).withColumn(
        out, F.col("_before") + F.col(ROW) + F.lit(start)
    )
    if total:
        numbered = numbered.withColumn(total, F.col("_total"))
    return numbered.drop(FILE, ROW, "_before", "_total")


def number_sorted(
    df: DataFrame,
    keys: Sequence[str],
    out: str,
    start: int = 1,
    total: str | None = None,
) -> DataFrame:
    """Number rows by ``keys``, whose combination is unique; missing keys come first.

    All columns of ``df`` are sorted and written, so give narrow rows and join the rest.
    ``total`` names an optional column that receives the number of rows.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return number_placed(placed(staged(dealt, "sorted"), FILE, ROW), out, start, total)


def number_within(
    df: DataFrame, keys: Sequence[str], out: str, within: Sequence[str], start: int = 1
) -> DataFrame:
    """Number rows by ``keys`` separately for each group, from one order of all rows."""
    numbered = number_sorted(df, [*within, *keys], "_number")
    firsts = numbered.groupBy(*within).agg(F.min("_number").alias("_first"))
    shifted = F.col("_number") - F.col("_first") + F.lit(start)
    return numbered.join(firsts, list(within)).withColumn(out, shifted).drop("_number", "_first")


def shuffle_key(ident: Column, seed: float | int) -> Column:
    """A sort key that orders ids at random, the same in any engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), ident.cast("string")).cast("binary"))


def number_shuffled(
    df: DataFrame,
    ident: str,
    seed: float | int,
    out: str,
    start: int = 1,
    total: str | None = None,
) -> DataFrame:
    """Number rows in random order by a unique id; no hash can be hot."""
    keyed = df.withColumn("_shuffle", shuffle_key(F.col(ident), seed))
    numbered = number_sorted(keyed, ["_shuffle", ident], out, start=start, total=total)
    return numbered.drop("_shuffle")

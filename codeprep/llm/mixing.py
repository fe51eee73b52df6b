"""Mixing sources to target weights: raking (iterative proportional fitting) and sampling.

SQL functions only. Everything iterates on the table of cells (one row per combination of
the marginal columns), never on documents.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeprep.llm.stage import free_name, stage

WORDS = "[^\\x20\\x09-\\x0D]+"
MAX_ROUNDS = 50
TOLERANCE = 1e-6


def token_weight(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic from fixed signs in the text: the first that fits, else ``prose``."""
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty")
        .when(text.contains("@"), "contact")
        .when(text.rlike("[#*$%&|<>]{3}"), "markup")
        .when(text.contains(" | "), "table")
        .when(text.rlike("[0-9]{4}"), "numbers")
        .otherwise("prose")
    )


def cell_totals(docs: DataFrame, marginals: Sequence[str], weight: str) -> DataFrame:
    """Documents and weight per cell; a missing value is a value of its own."""
    return docs.groupBy(*marginals).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(weight).cast("double").alias("total")
    )


def tempered_targets(cells: DataFrame, column: str, power: float) -> DataFrame:
    """Target shares of one marginal: its shares raised to ``power`` and made to sum to 1.

    Below 1 that lifts small categories. Categories without weight get no share.
    """
    sums = cells.groupBy(column).agg(F.sum("total").alias("_t")).filter("_t > 0")
    everything = Window.partitionBy()
    raised = sums.withColumn("_p", F.pow(F.col("_t"), F.lit(power)))
    return raised.select(column, (F.col("_p") / F.sum("_p").over(everything)).alias("target"))


def rake(
    cells: DataFrame,
    targets: Mapping[str, DataFrame],
    max_rounds: int = MAX_ROUNDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``cells`` with ``fitted``: weights whose sums per marginal meet the target shares.

    ``targets`` has one table (column, target) per marginal; shares sum to 1. A category
    without a target keeps no weight. Rounds end when every marginal is met within
    ``tolerance`` or after ``max_rounds``: targets that contradict each other (a category
    whose only cells are bound elsewhere) are met as nearly as the last round got. The
    table is written after each round, so a lost executor repeats one round.
    """
    goals = cells.withColumn("fitted", F.col("total"))
    for column, table in targets.items():
        goal = table.select(F.col(column).alias("_key"), F.col("target").alias(f"_goal_{column}"))
        goals = goals.join(goal, F.col(column).eqNullSafe(F.col("_key")), "left").drop("_key")
        goals = goals.fillna(0.0, [f"_goal_{column}"])
    fitted = stage(goals, "cells")
    for _ in range(max_rounds):
        for column in targets:
            share = F.sum("fitted").over(Window.partitionBy(column))
            fitted = fitted.withColumn(
                "fitted",
                F.when(share > 0, F.col("fitted") * F.col(f"_goal_{column}") / share).otherwise(0.0),
            )
        fitted = stage(fitted, "raked")
        if worst_gap(fitted, list(targets)) <= tolerance:
            break
    return fitted.drop(*[f"_goal_{c}" for c in targets])


def worst_gap(fitted: DataFrame, columns: Sequence[str]) -> float:
    """The largest distance of any category's share from its target: one number."""
    gaps = [
        fitted.groupBy(c)
        .agg(F.abs(F.sum("fitted") - F.max(f"_goal_{c}")).alias("gap"))
        .select("gap")
        for c in columns
    ]
    found = reduce(DataFrame.union, gaps).agg(F.max("gap")).first()[0]
    return found or 0.0


def with_rates(cells: DataFrame, keep: float) -> DataFrame:
    """``copies``: how often a document of a cell is expected in the mix; ``rate``: the
    chance with which it is taken when each document may come once at most.

    Both follow fitted weight over present weight, scaled so that a share ``keep`` of the
    total weight is expected. Copies may pass 1 and meet the targets. Rates that would
    pass 1 stay 1 and the others are raised until the total fits or every cell with a
    target is taken whole; where that happens they no longer meet the targets.
    """
    ratio = F.when(F.col("total") > 0, F.col("fitted") / F.col("total")).otherwise(0.0)
    cells = stage(cells.withColumn("_ratio", ratio), "ratios")
    wanted = keep * (cells.agg(F.sum("total")).first()[0] or 0.0)
    scale = 0.0
    for _ in range(MAX_ROUNDS):
        whole = F.col("_ratio") * scale >= 1
        full, rest = cells.agg(
            F.coalesce(F.sum(F.when(whole, F.col("total"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~whole, F.col("fitted"))), F.lit(0.0)),
        ).first()
        before, scale = scale, max(scale, (wanted - full) / rest if rest > 0 else scale)
        if scale <= before:
            break
    cells = cells.withColumn("copies", F.col("_ratio") * wanted)
    return cells.withColumn("rate", F.least(F.col("_ratio") * scale, F.lit(1.0))).drop("_ratio")


def draw(ident: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ident), 11)
    return bits.cast("double") / float(1 << 53)


def mixed(
    docs: DataFrame,
    marginals: Sequence[str],
    weight: str,
    ident: str,
    power: float = 0.7,
    keep: float = 0.8,
    seed: int = 42,
) -> DataFrame:
    """``docs`` with ``fitted_share``, ``expected_copies``, ``n_copies``, ``probability`` and
    ``selected``.

    Shares of every marginal are tempered by ``power`` and cells are raked to them. The mix
    that meets the targets has each document ``n_copies`` times: the whole part of
    ``expected_copies``, and one more by a draw of the fraction. ``selected`` is the draw
    in which no document repeats, with ``probability``; small cells that are taken whole
    stay below their targets there. Draws are a hash of the id: equal rows share a fate,
    and a rerun takes the same documents. A null category is a category, a null id draws
    like any value, a null weight counts 0, and documents without weight are taken at the
    rate of their cell. An empty table gives an empty result. The cells are joined back
    without a hint: Spark sends them along if they are small, and splits a hot source if
    they are not.
    """
    weighted = docs.withColumn(weight, F.coalesce(F.col(weight), F.lit(0)))
    cells = stage(cell_totals(weighted, marginals, weight), "totals")
    targets = {c: tempered_targets(cells, c, power) for c in marginals}
    rates = with_rates(rake(cells, targets), keep)
    names = {c: free_name(f"_cell_{c}", docs.columns) for c in marginals}
    table = stage(
        rates.select(
            *[F.col(c).alias(n) for c, n in names.items()],
            F.col("fitted").alias("fitted_share"),
            F.col("copies").alias("expected_copies"),
            F.col("rate").alias("probability"),
        ),
        "rates",
    )
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    whole = F.floor("expected_copies")
    more = draw([ident], seed) < F.col("expected_copies") - whole
    return (
        docs.join(table, on, "left")
        .drop(*names.values())
        .withColumn("n_copies", whole + more.cast("long"))
        .withColumn("selected", draw([ident], seed) < F.col("probability"))
    )

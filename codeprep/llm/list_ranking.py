"""Prefix sums along a linked list that is spread over many tasks.

A list is a table (at, next, weights...): ``next`` is null at its end. First the list is
contracted inside blocks of ``at``: what follows each other within one block becomes one
element. What is left is contracted by random mates, round by round: an element that drew 1
takes in its successor that drew 0, so about a quarter goes each time. A rest that fits one
block is summed there, and the elements taken in get their sums back in reverse order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeprep.llm.stage import stage

# Elements that one task looks at together: some 10 MB.
BLOCK = 1 << 17


def block_runs(part: pd.DataFrame, weights: Sequence[str]) -> pd.DataFrame:
    """For each element of a block: the head of its run, the sums before it, whether it ends one.

    By pointer jumping over the predecessors within the block.
    """
    part = part.sort_values("at", ignore_index=True)
    at = part["at"].to_numpy()
    following = part["next"].fillna(-1).to_numpy().astype(np.int64)
    spot = np.minimum(np.searchsorted(at, following), len(at) - 1)
    inside = at[spot] == following
    head = np.arange(len(at))
    head[spot[inside]] = np.flatnonzero(inside)
    first = head == np.arange(len(at))
    before = {}
    for name in weights:
        value = part[name].to_numpy()
        before[name] = np.where(first, 0, value[head])
    while True:
        further = head[head]
        if (further == head).all():
            break
        for name in weights:
            before[name] = before[name] + before[name][head]
        head = further
    part["head"] = at[head]
    part["ends"] = ~inside
    for name in weights:
        part[f"before_{name}"] = before[name]
    return part


def runs(elements: DataFrame, weights: Sequence[str], block: F.Column) -> DataFrame:
    """The elements with the head of their run, and the sums of their run before them."""
    kind = "at bigint, next bigint, head bigint, ends boolean, "
    kind += ", ".join(f"{w} bigint, before_{w} bigint" for w in weights)
    names = [f.split()[0] for f in kind.split(", ")]
    dealt = elements.select("at", "next", *weights, block.alias("_block"))
    return dealt.groupBy("_block").applyInPandas(
        lambda part: block_runs(part, weights)[names], kind
    )


def mates(elements: DataFrame, weights: Sequence[str], turn: int) -> DataFrame:
    """Pairs (g, t) of one round: g takes in its successor t; one of them null: it stays."""

    def coin(name: str) -> F.Column:
        return F.xxhash64(F.lit(turn), F.col(name)).bitwiseAND(F.lit(1)) == 1

    columns = ["at", "next", *weights]
    g = F.struct(*columns).alias("g")
    giving = coin("at") & F.col("next").isNotNull() & ~coin("next")
    givers = elements.filter(giving).select(g, F.col("next").alias("_at"))
    takers = elements.filter(~coin("at")).select(F.struct(*columns).alias("t"), F.col("at").alias("_at"))
    others = elements.filter(coin("at") & (F.col("next").isNull() | coin("next")))
    joined = givers.join(takers, "_at", "right").select("g", "t")
    kind = takers.schema["t"].dataType
    return joined.unionByName(others.select(g, F.lit(None).cast(kind).alias("t")))


def sums_before(
    elements: DataFrame, weights: Sequence[str], most: int = BLOCK, turn: int = 0
) -> DataFrame:
    """(at, before_...): the sums of the weights of all elements that come earlier in the list.

    ``elements`` must be a written table that holds one list; it is read several times.
    ``at`` and ``next`` are whole numbers, dense ones make good blocks. ``most`` is how many
    elements one task may hold. An empty table gives an empty one.
    """
    before = [f"before_{w}" for w in weights]
    if elements.count() <= most:
        return runs(elements, weights, F.lit(0)).select("at", *before)
    if turn == 0:
        local = stage(runs(elements, weights, F.expr(f"`at` div {most}")), "runs")
        short = local.filter("ends").select(
            F.col("head").alias("at"),
            "next",
            *[(F.col(w) + F.col(f"before_{w}")).alias(w) for w in weights],
        )
        top = sums_before(stage(short, "run-list"), weights, most, turn + 1)
        top = top.select(F.col("at").alias("head"), *[F.col(b).alias(f"_{b}") for b in before])
        return local.join(top, "head").select(
            "at", *[(F.col(b) + F.col(f"_{b}")).alias(b) for b in before]
        )
    paired = stage(mates(elements, weights, turn), "mates")
    kept = F.coalesce("g.at", "t.at").alias("at")
    onward = F.when(F.col("g").isNotNull() & F.col("t").isNull(), F.col("g.next"))
    shorter = paired.select(
        kept,
        onward.otherwise(F.col("t.next")).alias("next"),
        *[
            (F.coalesce(f"g.{w}", F.lit(0)) + F.coalesce(f"t.{w}", F.lit(0))).alias(w)
            for w in weights
        ],
    )
    deeper = stage(sums_before(stage(shorter, "shorter"), weights, most, turn + 1), "sums")
    taken = paired.filter(F.col("g").isNotNull() & F.col("t").isNotNull()).select(
        F.col("t.at").alias("_at"), F.col("g.at").alias("at"), *[F.col(f"g.{w}").alias(w) for w in weights]
    )
    back = taken.join(deeper, "at").select(
        F.col("_at").alias("at"), *[(F.col(f"before_{w}") + F.col(w)).alias(f"before_{w}") for w in weights]
    )
    return deeper.unionByName(back)

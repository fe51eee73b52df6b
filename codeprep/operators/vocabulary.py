"""Vocabulary of the most frequent tokens."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeprep.functions.lookup import constant_lookup
from codeprep.functions.text import word_tokens
from codeprep.operators.numbering import number_sorted
from codeprep.staging import spread, staged

# Ids of padding and of tokens outside the vocabulary.
PAD_ID = 0
UNKNOWN_ID = 1
FIRST_ID = 2

# A vocabulary of up to this many tokens (some 30 bytes each) goes to every task whole, and
# a larger one is joined. Both give the same rows.
INLINE_TOKENS = 200_000


@dataclass(frozen=True)
class Vocabulary:
    """Tokens with their ids; ``size`` is an upper bound of the row count of ``table``."""

    table: DataFrame
    size: int

    @property
    def inline(self) -> bool:
        return self.size <= INLINE_TOKENS

    @cached_property
    def _find(self):
        rows = self.table.select("token", "token_id").limit(self.size + 1).collect()
        if len(rows) > self.size:
            raise ValueError(f"the vocabulary has more than {self.size} tokens")
        return constant_lookup({r["token"]: r["token_id"] for r in rows}, "int")

    def ids_of(self, words: Column) -> Column:
        """The id of each word in a list, without a join; null for a null list."""
        if not self.inline:
            raise ValueError("this vocabulary is too large to travel with the tasks")
        find = self._find
        return F.transform(words, lambda w: F.coalesce(find(w), F.lit(UNKNOWN_ID)))


def token_counts(df: DataFrame, text: Column) -> DataFrame:
    """Occurrences per token; frequent tokens are summed before the shuffle."""
    texts = spread(df.select(text.alias("text")))
    tokens = texts.select(F.explode(word_tokens(F.col("text"))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def cutoff(counts: DataFrame, size: int) -> int | None:
    """The lowest count among the ``size`` most frequent tokens; None when there are fewer.

    Only how many tokens have each count is summed up in one task: different counts are
    few (their sum is at most the number of tokens in the texts).
    """
    per = counts.groupBy("n").agg(F.count(F.lit(1)).alias("_tokens"))
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    summed = per.withColumn("_above", F.sum("_tokens").over(above))
    return summed.filter(F.col("_above") >= size).agg(F.max("n")).first()[0]


def build_vocabulary(df: DataFrame, text: Column, size: int) -> Vocabulary:
    """The ``size`` most frequent tokens, ties by token, numbered from ``FIRST_ID``.

    Tokens below the cutoff are dropped before the sort, and those that are left are
    numbered over all tasks.
    """
    counts = staged(token_counts(df, text), "token-counts")
    least = cutoff(counts, size)
    kept = counts if least is None else counts.filter(F.col("n") >= least)
    ordered = kept.select("token", "n", (-F.col("n")).alias("_order"))
    numbered = number_sorted(ordered, ["_order", "token"], "_rank", start=0)
    table = numbered.filter(F.col("_rank") < size).select(
        "token", "n", (F.col("_rank") + FIRST_ID).cast("int").alias("token_id")
    )
    return Vocabulary(table, size)

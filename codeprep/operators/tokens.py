"""Texts to fixed-length token arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeprep.config import DEFAULT_MAX_LENGTH
from codeprep.functions.text import clean_text, word_tokens
from codeprep.operators.vocabulary import PAD_ID, UNKNOWN_ID, Vocabulary
from codeprep.schemas import TOKENS
from codeprep.staging import spread, staged_rows

TOKEN_COLUMNS = ("input_ids", "attention_mask", "labels")


def token_ids(
    df: DataFrame,
    keys: Sequence[str],
    text: Column,
    vocabulary: Vocabulary,
    max_length: int | None,
) -> DataFrame:
    """Token ids per text in order, cut on the right at ``max_length``; none for a null text.

    One row per row of ``df``, whether or not ``keys`` are unique.

    With a vocabulary that fits into the tasks, each row is handled by itself and nothing
    is shuffled. A larger one is joined.
    """
    words = word_tokens(text)
    if max_length is not None:
        words = F.slice(words, 1, max_length)
    if vocabulary.inline:
        none = F.array().cast(TOKENS)
        return df.select(*keys, F.coalesce(vocabulary.ids_of(words), none).alias("ids"))
    return _joined_ids(df.select(*keys, words.alias("_words")), keys, vocabulary)


def _joined_ids(df: DataFrame, keys: Sequence[str], vocabulary: Vocabulary) -> DataFrame:
    """Ids by a join; adaptive execution splits the partitions of very frequent tokens.

    A row is known by its place in a written table, so rows with equal keys stay apart, and
    a task that runs again finds the same places.
    """
    rows = staged_rows(df, "words")
    words = rows.select(*keys, "_file", "_row", F.posexplode_outer("_words").alias("_at", "token"))
    found = words.join(vocabulary.table.select("token", "token_id"), "token", "left")
    entry = F.struct("_at", F.coalesce("token_id", F.lit(UNKNOWN_ID)).alias("id"))
    present = F.when(F.col("_at").isNotNull(), entry)
    gathered = found.groupBy(*keys, "_file", "_row").agg(
        F.transform(F.array_sort(F.collect_list(present)), lambda e: e["id"]).alias("ids")
    )
    return gathered.drop("_file", "_row")


def padded(df: DataFrame, keys: Sequence[str], max_length: int | None) -> DataFrame:
    """Pad on the right to ``max_length`` and add the mask; no padding when None."""
    ids, n = F.col("ids"), F.size("ids")
    mask = F.array_repeat(F.lit(1), n)
    if max_length is not None:
        gap = F.greatest(F.lit(max_length) - n, F.lit(0))
        ids = F.concat(ids, F.array_repeat(F.lit(PAD_ID), gap))
        mask = F.concat(mask, F.array_repeat(F.lit(0), gap))
    return df.select(*keys, ids.alias("input_ids"), mask.alias("attention_mask"))


def with_labels(df: DataFrame) -> DataFrame:
    """Labels that copy the ids, padding included."""
    return df.withColumn("labels", F.col("input_ids"))


def causal_tokens(
    texts: DataFrame,
    keys: Sequence[str],
    vocabulary: Vocabulary,
    max_length: int = DEFAULT_MAX_LENGTH,
) -> DataFrame:
    """Cut and padded ids, mask and labels."""
    ids = token_ids(spread(texts, *keys), keys, F.col("text"), vocabulary, max_length)
    return with_labels(padded(ids, keys, max_length))


def cleaned_tokens(
    texts: DataFrame,
    keys: Sequence[str],
    vocabulary: Vocabulary,
    max_length: int = DEFAULT_MAX_LENGTH,
    padding: bool = True,
    truncation: bool = True,
) -> DataFrame:
    """Tokens of the cleaned text, optionally padded and cut."""
    cleaned = clean_text(F.col("text"))
    ids = token_ids(spread(texts, *keys), keys, cleaned, vocabulary, max_length if truncation else None)
    return padded(ids, keys, max_length if padding else None)


def tokens_to_json(df: DataFrame, columns: Sequence[str] = TOKEN_COLUMNS) -> DataFrame:
    """Each token array as JSON text."""
    return df.withColumns({c: F.to_json(F.col(c)) for c in columns})


def tokens_from_json(df: DataFrame, columns: Sequence[str] = TOKEN_COLUMNS) -> DataFrame:
    """Back from JSON text to integer arrays."""
    return df.withColumns({c: F.from_json(F.col(c), TOKENS) for c in columns})

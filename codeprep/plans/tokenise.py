"""Split fact table to token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeprep.config import DEFAULT_MAX_LENGTH
from codeprep.operators.examples import (
    causal_texts,
    example_records,
    prompt_pairs,
    training_examples,
)
from codeprep.operators.numbering import number_within
from codeprep.operators.tokens import padded, token_ids, with_labels
from codeprep.operators.vocabulary import Vocabulary, build_vocabulary
from codeprep.session import applied
from codeprep.sources.facts import read_fact
from codeprep.sources.token_tables import token_path, vocabulary_path, write_tokens
from codeprep.staging import job_scratch

KEYS = ("split", "row_id")


def training_texts(fact: DataFrame, version: str) -> DataFrame:
    """Prompt and completion as one text per usable fact row."""
    examples = training_examples(example_records(fact, version, *KEYS))
    return causal_texts(prompt_pairs(examples, *KEYS), *KEYS)


def with_example_ids(df: DataFrame) -> DataFrame:
    """``id`` from 0 within each split, in row number order."""
    return number_within(df, ["row_id"], "id", within=["split"], start=0)


def tokenise(
    spark: SparkSession,
    out_dir: str,
    version: str,
    vocabulary_size: int,
    max_length: int = DEFAULT_MAX_LENGTH,
    shuffled_bytes: int | None = None,
) -> Vocabulary:
    """Build the vocabulary from the training split and write both it and the token tables.

    Example ids are numbered on the two key columns alone and joined to the bare token ids,
    so no text is shuffled. With ``shuffled_bytes`` (about 6 bytes per kept token) the job
    runs under ``session.recommended_settings``.
    """
    texts = training_texts(read_fact(spark, out_dir, version), version)
    train = texts.filter(F.col("split") == "train")
    path = vocabulary_path(out_dir, version)
    with applied(spark, shuffled_bytes), job_scratch(spark):
        built = build_vocabulary(train, F.col("text"), vocabulary_size)
        built.table.write.mode("overwrite").parquet(path)
        vocabulary = Vocabulary(spark.read.parquet(path), built.size)
        ids = token_ids(texts, KEYS, F.col("text"), vocabulary, max_length)
        numbered = ids.join(with_example_ids(texts.select(*KEYS)), list(KEYS))
        tokens = with_labels(padded(numbered, [*KEYS, "id"], max_length))
        write_tokens(tokens, token_path(out_dir, version))
    return vocabulary

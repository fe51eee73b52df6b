"""A training corpus from raw documents: five stages, each the work of one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeprep.llm import jaccard_join, mixing, pieces, quality_rules, substring_dedup
from codeprep.llm.stage import free_name, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word n-grams at a similarity of 0.8."""
    return jaccard_join.one_of_each(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat; documents that lose all their words go."""
    cut = substring_dedup.without_repeats(docs)
    cut = cut.filter(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet tempered weights.

    A document that is drawn several times comes as so many equal rows.
    """
    topic, tokens = free_name("_topic", docs.columns), free_name("_tokens", docs.columns)
    tagged = docs.withColumn(topic, mixing.topic(F.col("text")))
    tagged = tagged.withColumn(tokens, mixing.token_weight(F.col("text")))
    taken = mixing.mixed(tagged, ["source", "lang", topic], tokens, "doc_id")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies")))
    taken = taken.filter("n_copies > 0").select("*", copies.alias(free_name("_copy", taken.columns)))
    return taken.select(*docs.columns)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids."""
    ids = free_name("piece_ids", docs.columns)
    found = pieces.with_pieces(docs, ids)
    return found.withColumn(free_name("n_pieces", found.columns), F.size(ids).cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing", mixing_weights),
    ("sentence pieces", sentence_pieces),
]

# Compression ratios, hashed draws and the tokenizer have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

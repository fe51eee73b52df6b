"""Training examples: text, codes and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeprep.config import DatasetVersion, dataset_version
from codeprep.functions import codes as C
from codeprep.functions import text as X
from codeprep.operators.grouping import group_codes
from codeprep.operators.joins import SALT, copied, dealt, hot_keys


def _metadata(v: DatasetVersion) -> Column:
    return F.struct(
        F.lit(v.name).alias("source"),
        F.col("HADM_ID").alias("hadm_id"),
        F.col("SUBJECT_ID").alias("subject_id"),
        F.col(v.kind_col).alias(v.metadata_kind),
    )


def prefixed_codes(version: str | DatasetVersion) -> Column:
    """Diagnoses then procedures, each with the code system in front."""
    v = dataset_version(version)
    every = C.all_codes(F.col("diagnosis_codes"), F.col("procedure_codes"))
    return C.with_system(every, v.code_system)


def example_records(fact: DataFrame, version: str | DatasetVersion, *keep: str) -> DataFrame:
    """One example per fact row; a missing text becomes an empty one."""
    v = dataset_version(version)
    return fact.select(
        *keep,
        F.coalesce(F.col("TEXT"), F.lit("")).alias("text"),
        prefixed_codes(v).alias("codes"),
        _metadata(v).alias("metadata"),
    )


def usable() -> Column:
    """Whether an example has a text and at least one code."""
    return (F.length("text") > 0) & (F.size("codes") > 0)


def training_examples(examples: DataFrame) -> DataFrame:
    """Examples with a text and at least one code."""
    return examples.filter(usable())


def examples_with_required_fields(examples: DataFrame) -> DataFrame:
    """Examples that have both fields, empty or not; missing metadata becomes an empty record."""
    kept = examples.filter(F.col("text").isNotNull() & F.col("codes").isNotNull())
    if "metadata" not in examples.columns:
        return kept.withColumn("metadata", F.struct())
    kind = examples.schema["metadata"].dataType
    empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])
    return kept.withColumn("metadata", F.coalesce("metadata", empty))


def examples_by_admission(
    notes: DataFrame,
    codes: DataFrame,
    version: str | DatasetVersion,
    row_key: str,
    *keep: str,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Notes of every kind with the codes of their admission, matched on the admission alone.

    Notes without an admission, or with admission 0, are left out. ``row_key`` identifies
    a note: the text takes no part in the match and joins by that key. ``hot`` is the table
    of ``joins.hot_keys`` of the notes by admission, where it is known already.
    """
    v = dataset_version(version)
    on = ["HADM_ID"]
    admitted = notes.filter(F.col("HADM_ID") != 0)
    narrow = admitted.select(*{row_key: 0, "HADM_ID": 0, "SUBJECT_ID": 0, v.kind_col: 0})
    if hot is None:
        hot = hot_keys(narrow, on)
    grouped = group_codes(copied(codes, on, hot), v, "codes", keys=[*on, SALT])
    matched = dealt(narrow, on, hot, [row_key]).join(grouped, [*on, SALT])
    texts = admitted.select(row_key, "TEXT").repartition(row_key)
    return matched.join(texts, row_key).select(
        *keep,
        F.coalesce(F.col("TEXT"), F.lit("")).alias("text"),
        C.with_system(F.col("codes"), v.code_system).alias("codes"),
        _metadata(v).alias("metadata"),
    )


def prompt_pairs(examples: DataFrame, *keep: str) -> DataFrame:
    """A prompt and a completion per example."""
    return examples.select(
        *keep,
        X.prompt(F.col("text")).alias("prompt"),
        X.completion(F.col("codes")).alias("completion"),
    )


def causal_texts(pairs: DataFrame, *keep: str) -> DataFrame:
    """Prompt and completion as one text."""
    return pairs.select(*keep, X.causal_text(F.col("prompt"), F.col("completion")).alias("text"))

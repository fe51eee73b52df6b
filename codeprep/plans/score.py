"""Documents or texts to described codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeprep.config import DEFAULT_BATCH_SIZE, DEFAULT_MAX_CODES
from codeprep.functions import codes as C
from codeprep.operators.descriptions import describe_codes
from codeprep.operators.envelopes import error_envelope, response_envelope
from codeprep.operators.scoring import ModelFn, batch_predict
from codeprep.sources.paths import under
from codeprep.sources.predictions import save_results


def predictions(
    scored: DataFrame,
    keys: Sequence[str],
    max_codes: int,
    descriptions: dict[str, str] | DataFrame | None,
) -> DataFrame:
    """Cap the codes and turn them into ``{code, description}`` records.

    Without descriptions, or with a configured dictionary, this is an expression within the
    row. A dictionary table is joined.
    """
    capped = scored.withColumn("codes", C.cap_codes(F.col("codes"), max_codes))
    if isinstance(descriptions, DataFrame):
        return describe_codes(capped, keys, descriptions)
    codes: Column = F.col("codes")
    records = C.undescribed(codes) if descriptions is None else C.described(codes, descriptions)
    return capped.withColumn("predictions", records)


def score_documents(
    documents: DataFrame,
    keys: Sequence[str],
    model_fn: ModelFn,
    model_version: str,
    max_codes: int = DEFAULT_MAX_CODES,
    descriptions: dict[str, str] | DataFrame | None = None,
    batch_size: int = DEFAULT_BATCH_SIZE,
    text: str = "content",
) -> DataFrame:
    """Every document with its described codes, its metadata, and an error where it failed."""
    scored = batch_predict(documents, model_fn, model_version, text, batch_size)
    return predictions(scored.drop(text), keys, max_codes, descriptions)


def responses(
    scored: DataFrame, keys: Sequence[str], timestamp: str, kind: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Response records of the documents that worked, error records of the others.

    Both read ``scored``; stage it first, as ``score_to_json`` does, or the model runs for
    each of them.
    """
    worked = scored.filter(F.col("error").isNull())
    return (
        response_envelope(worked, keys, timestamp, *keys),
        error_envelope(scored, keys, timestamp, kind, *keys),
    )


def score_to_json(
    documents: DataFrame,
    keys: Sequence[str],
    model_fn: ModelFn,
    model_version: str,
    out_dir: str,
    timestamp: str,
    kind: str = "pdf",
    **options,
) -> DataFrame:
    """Score once, then write response and error records as JSON under ``out_dir``.

    Returns the scored rows, which lie there as Parquet. ``options`` go to
    ``score_documents``.
    """
    found = score_documents(documents, keys, model_fn, model_version, **options)
    path = under(out_dir, "scored")
    found.write.mode("overwrite").parquet(path)
    scored = documents.sparkSession.read.schema(found.schema).parquet(path)
    worked, failed = responses(scored, keys, timestamp, kind)
    save_results(worked, under(out_dir, "responses"))
    save_results(failed, under(out_dir, "errors"))
    return scored

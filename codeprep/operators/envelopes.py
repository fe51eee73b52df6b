"""Response and error records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code, message and suggestion of the two kinds of error.
ERRORS = {
    "text": (
        "PREDICTION_ERROR",
        "Error predicting codes",
        "Please try again with different text",
    ),
    "pdf": (
        "PDF_PROCESSING_ERROR",
        "PDF file could not be processed",
        "Please ensure the PDF is valid and contains text",
    ),
}


def request_id(*keys: str) -> Column:
    """An id made from the input's key, so that a rerun gives the same one."""
    return F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), 256)


def response_envelope(
    scored: DataFrame, keys: Sequence[str], timestamp: str, *keep: str
) -> DataFrame:
    """Request id, time stamp, predictions, processing time and model information."""
    return scored.select(
        *keep,
        request_id(*keys).alias("request_id"),
        F.lit(timestamp).alias("timestamp"),
        F.col("predictions"),
        F.col("processing_time"),
        F.struct(
            F.coalesce("model_version", F.lit("unknown")).alias("version"),
            F.lit(timestamp).alias("timestamp"),
        ).alias("model_info"),
    )


def error_envelope(
    failed: DataFrame, keys: Sequence[str], timestamp: str, kind: str = "text", *keep: str
) -> DataFrame:
    """Code, message, reason and suggestion for rows with an ``error``."""
    code, message, suggestion = ERRORS[kind]
    return failed.filter(F.col("error").isNotNull()).select(
        *keep,
        F.struct(
            F.lit(code).alias("code"),
            F.lit(message).alias("message"),
            F.struct(
                F.col("error").alias("reason"), F.lit(suggestion).alias("suggestion")
            ).alias("details"),
        ).alias("error"),
        request_id(*keys).alias("request_id"),
        F.lit(timestamp).alias("timestamp"),
    )

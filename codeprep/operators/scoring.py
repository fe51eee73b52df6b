"""Running a model over a column of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeprep.config import DEFAULT_BATCH_SIZE, EMPTY_DOCUMENT
from codeprep.functions import codes as C
from codeprep.functions import text as X

ModelFn = Callable[[list[str]], list[str]]

_SCORED = T.StructType(
    [
        T.StructField("response", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("processing_time", T.DoubleType()),
    ]
)


def _model_column(model_fn: ModelFn, batch_size: int):
    """A vectorised function from prompts to responses. Only the prompt leaves the JVM."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import time

        def answer(prompts: list[str]) -> list[tuple]:
            begun = time.perf_counter()
            responses = list(model_fn(prompts))
            if len(responses) != len(prompts):
                raise ValueError(f"{len(prompts)} texts gave {len(responses)} responses")
            each = (time.perf_counter() - begun) / len(prompts)
            return [(response, None, each) for response in responses]

        def answer_each(prompts: list[str]) -> list[tuple]:
            try:
                return answer(prompts)
            except Exception as failure:
                if len(prompts) == 1:
                    return [(None, str(failure), 0.0)]
                # One text spoils its batch: ask for each on its own.
                return [row for p in prompts for row in answer_each([p])]

        for series in batches:
            rows: list[tuple] = [(None, None, 0.0)] * len(series)
            asked = [i for i, p in enumerate(series) if isinstance(p, str)]
            for at in range(0, len(asked), batch_size):
                places = asked[at : at + batch_size]
                for place, row in zip(places, answer_each([series.iloc[i] for i in places])):
                    rows[place] = row
            yield pd.DataFrame(rows, columns=["response", "error", "processing_time"])

    return F.pandas_udf(score, _SCORED).asNondeterministic()


def batch_predict(
    df: DataFrame,
    model_fn: ModelFn,
    model_version: str,
    text: str = "text",
    batch_size: int = DEFAULT_BATCH_SIZE,
) -> DataFrame:
    """Add the codes predicted for each text; a failing text gets no codes and its error.

    ``model_fn`` receives up to ``batch_size`` prompts and returns one response each. A
    missing or empty text is not sent to the model and gets the empty-document error. A row
    that comes with an ``error`` (a file that could not be read) keeps it and is not sent
    either. Other columns of the result's names are refused.
    """
    taken = {"codes", "model_version", "processing_time"} & set(df.columns)
    if taken:
        raise ValueError(f"the table already has {sorted(taken)}; rename or drop them")
    told = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    asked = F.when((F.length(text) > 0) & told.isNull(), X.prompt(F.col(text)))
    scored = df.withColumn("_prompt", asked).withColumn(
        "_scored", _model_column(model_fn, batch_size)(F.col("_prompt"))
    )
    answer = X.strip_prompt_echo(F.col("_scored.response"), F.col("_prompt"))
    empty = F.when(F.col("_prompt").isNull(), F.lit(EMPTY_DOCUMENT))
    error = F.coalesce(told, empty, F.col("_scored.error"))
    return scored.select(
        *[c for c in df.columns if c != "error"],
        C.or_empty(C.extract_codes(answer)).alias("codes"),
        F.lit(model_version).alias("model_version"),
        F.col("_scored.processing_time").alias("processing_time"),
        error.alias("error"),
    )


def empty_documents(documents: DataFrame) -> DataFrame:
    """Results for documents without text: the error, no codes, and the metadata."""
    return documents.filter(F.coalesce(F.length("content"), F.lit(0)) == 0).select(
        F.lit(EMPTY_DOCUMENT).alias("error"),
        C.no_codes().alias("codes"),
        F.col("metadata").alias("pdf_metadata"),
    )

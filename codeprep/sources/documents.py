"""Documents made of pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeprep.sources.paths import require

# Fixed value: how the reason of an unreadable file begins in a result.
UNREADABLE = "Could not process PDF"

Extractor = Callable[[bytes], list[str | None]]

_PAGES = T.StructType(
    [
        T.StructField("pages", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
        T.StructField("seconds", T.DoubleType()),
    ]
)


def page_text(pages: Column) -> Column:
    """Page texts one after the other; a page without text adds nothing."""
    return F.array_join(F.transform(pages, lambda p: F.coalesce(p, F.lit(""))), "")


def _extract_column(extractor: Extractor):
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import time

        for series in batches:
            rows = []
            for blob in series:
                begun = time.perf_counter()
                try:
                    rows.append((list(extractor(bytes(blob))), None, time.perf_counter() - begun))
                except Exception as failure:
                    rows.append((None, f"{UNREADABLE}: {failure}", 0.0))
            yield pd.DataFrame(rows, columns=["pages", "error", "seconds"])

    return F.pandas_udf(extract, _PAGES).asNondeterministic()


def read_documents(
    spark: SparkSession, path: str, extractor: Extractor, pattern: str = "*.pdf"
) -> DataFrame:
    """Files under ``path`` with their text, one row each.

    ``extractor`` turns the bytes of one file into its page texts. A file stays in one row
    from read to text, so nothing is shuffled. A file it cannot read gets an ``error``;
    Spark lists no files of zero bytes. For large files lower
    ``spark.sql.execution.arrow.maxRecordsPerBatch``, which counts files per batch here.
    The driver lists all files: very many small ones are better kept in packs (``read_packs``).
    """
    require(spark, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return extracted(files.select("path", "content"), extractor)


def read_packs(spark: SparkSession, path: str, extractor: Extractor) -> DataFrame:
    """Documents kept many to a file, with their text, one row each as from ``read_documents``.

    Packs are Parquet files under ``path`` with the columns of Spark's ``binaryFile`` source,
    ``path`` and ``content``. Their number follows the bytes and not the number of documents.
    """
    require(spark, path)
    packs = spark.read.schema("path string, content binary").parquet(path)
    return extracted(packs, extractor)


def extracted(files: DataFrame, extractor: Extractor) -> DataFrame:
    """(path, content, metadata, error) of files given as (path, bytes)."""
    files = files.withColumn("_read", _extract_column(extractor)(F.col("content")))
    return files.select(
        "path",
        page_text(F.col("_read.pages")).alias("content"),
        F.struct(
            F.element_at(F.split("path", "/"), -1).alias("filename"),
            F.size("_read.pages").alias("page_count"),
            F.col("_read.seconds").alias("extraction_time"),
        ).alias("metadata"),
        F.col("_read.error").alias("error"),
    )


def concat_pages(
    pages: DataFrame, keys: Sequence[str], page_no: str = "page_no", text: str = "text"
) -> DataFrame:
    """One text and page count per document from a table with one row per page.

    The text of a document is one cell, so its pages meet in one row. They are shuffled as
    they are; listing them on the map side first would only hold the texts in memory.
    """
    page = F.struct(F.col(page_no).alias("no"), F.col(text).alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list(page)), lambda p: p["text"])
    return pages.repartition(*keys).groupBy(*keys).agg(
        page_text(ordered).alias("content"), F.count(F.lit(1)).alias("page_count")
    )

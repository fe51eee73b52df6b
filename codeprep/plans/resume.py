"""Scoring that a failed job can take up again.

Documents are dealt once into parts by a hash of their keys and written. Each part is then
scored by a job of its own, and an entry in a ledger says that its rows are there. A second
run asks the model only for the parts that the ledger does not have. Of a part that was under
way nothing is kept: its rows are written again, in the same place.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from codeprep.operators.scoring import ModelFn
from codeprep.plans.score import responses, score_documents
from codeprep.sources.paths import exists, under
from codeprep.sources.predictions import save_results
from codeprep.staging import remove

PART = "_part"
PARTS = 16


def dealt(documents: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """The documents with their part, each part in several files so that it is many tasks."""
    cores = documents.sparkSession.sparkContext.defaultParallelism
    part = F.pmod(F.xxhash64(*keys), F.lit(parts))
    salt = F.pmod(F.xxhash64(*keys, F.lit("file")), F.lit(cores))
    return documents.withColumn(PART, part).repartition(F.col(PART), salt)


def ledger(spark: SparkSession, out_dir: str) -> dict[int, int]:
    """Finished parts with their numbers of rows: one entry per part, so at most ``parts``."""
    path = under(out_dir, "ledger")
    if not exists(spark, path):
        return {}
    entries = spark.read.schema(f"{PART} long, n_rows long").json(f"{path}/*")
    return {r[PART]: r["n_rows"] for r in entries.collect()}


def enter(spark: SparkSession, out_dir: str, part: int, rows: int) -> None:
    """Note a part as finished; its rows must lie there whole."""
    one = spark.createDataFrame([(part, rows)], f"{PART} long, n_rows long")
    one.coalesce(1).write.mode("overwrite").json(under(out_dir, f"ledger/{part}"))


def start(
    documents: DataFrame, keys: Sequence[str], out_dir: str, parts: int, settings: dict, overwrite: bool
) -> DataFrame:
    """The dealt documents, as written by the first run.

    A later run reads them and not ``documents``, so texts are extracted once. A run with
    other settings is refused unless it overwrites everything.
    """
    spark = documents.sparkSession
    said, path = json.dumps(settings, sort_keys=True), under(out_dir, "dealt")
    beside = under(out_dir, "settings")
    if overwrite and exists(spark, out_dir):
        remove(spark, out_dir)
    if exists(spark, under(path, "_SUCCESS")) and exists(spark, under(beside, "_SUCCESS")):
        made = spark.read.text(beside).first()[0]
        if made != said:
            raise ValueError(f"{out_dir} was begun with other settings ({made}); set overwrite")
    else:
        dealt(documents, keys, parts).write.mode("overwrite").partitionBy(PART).parquet(path)
        spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(beside)
    kind = StructType([*documents.schema, StructField(PART, LongType())])
    return spark.read.schema(kind).parquet(path)


def score_in_parts(
    documents: DataFrame,
    keys: Sequence[str],
    model_fn: ModelFn,
    model_version: str,
    out_dir: str,
    parts: int = PARTS,
    most: int | None = None,
    overwrite: bool = False,
    **options,
) -> DataFrame | None:
    """Score documents part by part under ``out_dir``; the scored rows, or None if parts are left.

    ``most`` limits how many parts this call scores. Rows of one key are one part, so a key
    that repeats is scored together. Null keys are a key like others. ``options`` go to
    ``score_documents``. The rows equal those of one run over all documents.
    """
    if parts < 1:
        raise ValueError("parts must be at least 1")
    spark = documents.sparkSession
    settings = {"keys": list(keys), "model_version": model_version, "parts": parts}
    settings |= {k: options[k] for k in ("max_codes", "batch_size", "text") if k in options}
    texts = start(documents, keys, out_dir, parts, settings, overwrite)
    done = ledger(spark, out_dir)
    left = [p for p in range(parts) if p not in done]
    for part in left if most is None else left[:most]:
        path = under(out_dir, f"scored/{PART}={part}")
        some = texts.filter(F.col(PART) == part).drop(PART)
        found = score_documents(some, keys, model_fn, model_version, **options)
        found.write.mode("overwrite").parquet(path)
        enter(spark, out_dir, part, spark.read.parquet(path).count())
    if most is not None and most < len(left):
        return None
    kind = score_documents(documents, keys, model_fn, model_version, **options).schema
    paths = [under(out_dir, f"scored/{PART}={p}") for p in range(parts)]
    return spark.read.schema(kind).parquet(*paths)


def records_to_json(scored: DataFrame, keys: Sequence[str], out_dir: str, timestamp: str, kind: str = "pdf") -> None:
    """Response and error records of scored rows as JSON, as ``score_to_json`` writes them."""
    worked, failed = responses(scored, keys, timestamp, kind)
    save_results(worked, under(out_dir, "responses"))
    save_results(failed, under(out_dir, "errors"))

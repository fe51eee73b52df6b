"""Raw tables to the split fact table."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeprep.config import PrepareSettings, dataset_version
from codeprep.operators.audit import require_unique, split_counts, stage_counts
from codeprep.operators.examples import example_records, usable
from codeprep.operators.fact import attach_text, fact_columns
from codeprep.operators.numbering import FILE, ROW, number_placed
from codeprep.operators.split import normalised_ratios, split_sequential, split_shuffled
from codeprep.plans.fact import row_numbers, staged_keys, with_numbers
from codeprep.session import applied
from codeprep.sources.facts import fact_path, read_fact, write_fact
from codeprep.sources.paths import exists, under
from codeprep.sources.tables import ingest, read_tables
from codeprep.staging import job_scratch, placed


def load_notes(
    spark: SparkSession, tables: dict[str, DataFrame], version: str
) -> DataFrame:
    """The notes with a unique key for each.

    Notes that came without a key column are numbered in file order. Where the column is
    there and a key is missing, the note gets one from its place that no other can have: a
    negative number, or ``row-`` and the number.
    """
    v = dataset_version(version)
    notes = tables["NOTEEVENTS"]
    if v.note_key not in notes.columns:
        return number_placed(placed(notes, FILE, ROW), v.note_key)
    require_unique(notes.dropna(subset=[v.note_key]), [v.note_key], "NOTEEVENTS")
    if not notes.filter(F.col(v.note_key).isNull()).isEmpty():
        notes = number_placed(placed(notes, FILE, ROW), "_place")
        text = dict(notes.dtypes)[v.note_key] == "string"
        own = F.concat(F.lit("row-"), F.col("_place")) if text else -F.col("_place")
        notes = notes.withColumn(v.note_key, F.coalesce(v.note_key, own)).drop("_place")
    return notes


def split_fact(
    tables: dict[str, DataFrame], notes: DataFrame, settings: PrepareSettings
) -> DataFrame:
    """The fact table with its ``split`` column.

    Row numbers and splits are made on three key columns. Lists and text join last, on the
    note key.
    """
    v = dataset_version(settings.version)
    keys = staged_keys(
        notes,
        tables["DIAGNOSES_ICD"],
        tables["PROCEDURES_ICD"],
        tables["PATIENTS"],
        v,
        settings.num_patients,
    )
    numbers = row_numbers(keys, v, total="n_rows")
    shares = normalised_ratios(settings.train, settings.val, settings.test)
    if settings.shuffled:
        labelled = split_shuffled(numbers, "row_id", *shares, seed=settings.seed)
    else:
        labelled = split_sequential(numbers, *shares)
    whole = attach_text(
        with_numbers(keys, labelled, v), notes, v, settings.num_patients is None
    )
    return fact_columns(whole, v, "split")


def settings_path(out_dir: str, version: str) -> str:
    return f"{fact_path(out_dir, version)}_settings"


def described(settings: PrepareSettings) -> str:
    """The settings that decide the rows of the fact table."""
    kept = {k: v for k, v in asdict(settings).items() if k != "overwrite"}
    return json.dumps(kept, sort_keys=True)


def prepare(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    settings: PrepareSettings,
    shuffled_bytes: int | None = None,
) -> DataFrame:
    """Ingest, build and write the fact table; returns it as written.

    A finished table with the same settings is kept unless ``settings.overwrite`` is set;
    one with other settings is refused without it. With ``shuffled_bytes`` (about the size
    of the texts) the job runs under ``session.recommended_settings``.
    """
    path = fact_path(out_dir, settings.version)
    beside = settings_path(out_dir, settings.version)
    finished = exists(spark, under(path, "_SUCCESS"))
    if finished and not settings.overwrite:
        made = spark.read.text(beside).first()[0] if exists(spark, beside) else "unknown"
        if made != described(settings):
            raise ValueError(
                f"{path} was made with other settings ({made}); set overwrite to replace it"
            )
    with applied(spark, shuffled_bytes), job_scratch(spark):
        ingest(spark, raw_dir, out_dir, settings.version, settings.overwrite)
        if settings.overwrite or not finished:
            tables = read_tables(spark, out_dir, settings.version)
            notes = load_notes(spark, tables, settings.version)
            write_fact(split_fact(tables, notes, settings), path)
            one = spark.createDataFrame([(described(settings),)], "value string")
            one.write.mode("overwrite").text(beside)
    return read_fact(spark, out_dir, settings.version)


def report(spark: SparkSession, out_dir: str, version: str) -> DataFrame:
    """Row counts of the ingested tables, the fact table, its splits and usable examples."""
    fact = read_fact(spark, out_dir, version)
    counts = stage_counts(read_tables(spark, out_dir, version))
    records = example_records(fact, version, "split")
    return counts.unionByName(split_counts(records, usable()))

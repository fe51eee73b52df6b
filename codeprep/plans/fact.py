"""The fact table, step by step; narrow steps are written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from codeprep.config import DatasetVersion, dataset_version
from codeprep.operators.cohort import patient_cohort, restrict_to_cohort
from codeprep.operators.fact import attach_text, fact_columns, fact_keys, narrow_notes
from codeprep.operators.grouping import ADMISSION
from codeprep.operators.joins import hot_keys
from codeprep.operators.numbering import number_sorted
from codeprep.staging import staged


def staged_keys(
    notes: DataFrame,
    diagnoses: DataFrame,
    procedures: DataFrame,
    patients: DataFrame,
    version: str | DatasetVersion,
    num_patients: int | None = None,
) -> DataFrame:
    """The fact rows without number and text, written once.

    Admissions with very many notes are counted once, and that small table is written too.
    """
    narrow = narrow_notes(notes, version)
    if num_patients is not None:
        cohort = staged(patient_cohort(narrow, num_patients), "cohort")
        narrow, diagnoses, procedures = (
            restrict_to_cohort(df, cohort) for df in (narrow, diagnoses, procedures)
        )
    narrow = narrow.dropna(subset=list(ADMISSION))
    hot = staged(hot_keys(narrow, ADMISSION), "hot-admissions")
    keys = fact_keys(narrow, diagnoses, procedures, patients, hot, version)
    return staged(keys, "fact-keys")


def row_numbers(
    keys: DataFrame, version: str | DatasetVersion, total: str | None = None
) -> DataFrame:
    """Note key and row number from 1, by patient, admission and note key.

    Only these three columns are sorted; the code lists stay where they are.
    """
    order = [*ADMISSION, dataset_version(version).note_key]
    return number_sorted(keys.select(*order), order, "row_id", total=total)


def with_numbers(
    keys: DataFrame, numbers: DataFrame, version: str | DatasetVersion
) -> DataFrame:
    """The fact rows with the columns of ``numbers``, by the note key."""
    key = dataset_version(version).note_key
    numbers = numbers.drop(*ADMISSION).withColumnRenamed(key, "_noted")
    return keys.join(numbers, keys[key].eqNullSafe(numbers["_noted"])).drop("_noted")


def numbered_keys(
    keys: DataFrame, version: str | DatasetVersion, total: str | None = None
) -> DataFrame:
    """The staged fact rows with their row number."""
    return with_numbers(keys, row_numbers(keys, version, total), version)


def processed_fact(
    notes: DataFrame,
    diagnoses: DataFrame,
    procedures: DataFrame,
    patients: DataFrame,
    version: str | DatasetVersion,
    num_patients: int | None = None,
) -> DataFrame:
    """The whole fact table: one row per discharge note of an admission with diagnoses."""
    keys = staged_keys(notes, diagnoses, procedures, patients, version, num_patients)
    whole = attach_text(numbered_keys(keys, version), notes, version, num_patients is None)
    return fact_columns(whole, version)

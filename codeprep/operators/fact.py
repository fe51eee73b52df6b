"""Joining notes, code lists and patients into the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeprep.config import DatasetVersion, dataset_version
from codeprep.functions import codes as C
from codeprep.operators.grouping import ADMISSION, admission_codes
from codeprep.operators.joins import SALT, copied, dealt, skew_safe_join
from codeprep.operators.notes import discharge_notes


def notes_with_diagnoses(
    notes: DataFrame, diagnoses: DataFrame, version: str | DatasetVersion
) -> DataFrame:
    """Notes whose admission has diagnoses; notes without patient or admission drop out."""
    v = dataset_version(version)
    return skew_safe_join(notes, diagnoses, ADMISSION, "inner", [v.note_key])


def notes_left_procedures(
    notes: DataFrame, procedures: DataFrame, version: str | DatasetVersion
) -> DataFrame:
    """All notes, with an empty list where the admission has no procedures."""
    v = dataset_version(version)
    joined = skew_safe_join(notes, procedures, ADMISSION, "left", [v.note_key])
    return joined.withColumn("procedure_codes", C.or_empty(F.col("procedure_codes")))


def with_gender(df: DataFrame, patients: DataFrame) -> DataFrame:
    """Add the patient's gender; ``patients`` holds one row per patient."""
    gender = patients.select("SUBJECT_ID", F.col("GENDER").alias("gender"))
    return df.join(gender, "SUBJECT_ID", "left")


def fact_keys(
    narrow: DataFrame,
    diagnoses: DataFrame,
    procedures: DataFrame,
    patients: DataFrame,
    hot: DataFrame,
    version: str | DatasetVersion,
) -> DataFrame:
    """The fact table without row number and text, from ``narrow_notes``.

    The salts of admissions with very many notes (``hot``, see ``joins.hot_keys``) are
    given to the codes before they are gathered, so the lists lie ready for the join and
    are not shuffled again. The gender joins last: its shuffle feeds the join directly,
    where adaptive execution splits a patient with many rows.
    """
    v = dataset_version(version)
    on = [*ADMISSION, SALT]
    lists = admission_codes(
        copied(diagnoses, ADMISSION, hot), copied(procedures, ADMISSION, hot), v, on
    )
    joined = dealt(narrow, ADMISSION, hot, [v.note_key]).join(lists, on).drop(SALT)
    return with_gender(joined, patients)


def narrow_notes(notes: DataFrame, version: str | DatasetVersion) -> DataFrame:
    """Key columns of the discharge notes; the text takes no part in joins and sorts."""
    v = dataset_version(version)
    return discharge_notes(notes, v).select(v.note_key, *ADMISSION, v.kind_col)


def fact_columns(df: DataFrame, version: str | DatasetVersion, *extra: str) -> DataFrame:
    """Order the fact columns and add the joined code strings."""
    v = dataset_version(version)
    every = C.all_codes(F.col("diagnosis_codes"), F.col("procedure_codes"))
    return df.select(
        "row_id",
        v.note_key,
        *ADMISSION,
        v.kind_col,
        "TEXT",
        "diagnosis_codes",
        "procedure_codes",
        every.alias("all_codes"),
        C.joined(F.col("diagnosis_codes")).alias("diagnosis_codes_str"),
        C.joined(F.col("procedure_codes")).alias("procedure_codes_str"),
        C.joined(every).alias("all_codes_str"),
        "gender",
        *extra,
    )


def attach_text(
    keys: DataFrame, notes: DataFrame, version: str | DatasetVersion, whole: bool = True
) -> DataFrame:
    """Bring the note text in by the unique note key, which cannot be hot.

    With ``whole`` the texts are dealt out by their key even where the keys would be small
    enough to be sent along, so that the work that follows on them has many tasks. A cohort
    needs few of the texts; they then stay where they are. A missing key is a key.
    """
    v = dataset_version(version)
    texts = discharge_notes(notes, v).select(F.col(v.note_key).alias("_key"), "TEXT")
    if whole:
        # The join itself deals them out; a repartition before it would shuffle them twice.
        texts = texts.hint("merge")
    return keys.join(texts, F.col(v.note_key).eqNullSafe(F.col("_key"))).drop("_key")

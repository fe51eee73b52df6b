"""The first N patients, and restriction of other tables to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeprep.operators.numbering import number_sorted


def patient_cohort(notes: DataFrame, num_patients: int | None) -> DataFrame:
    """The ``num_patients`` lowest distinct patient ids among ``notes``; all when None.

    A missing id sorts last, so it is taken only when there are fewer patients than asked.
    Ids are numbered without meeting in one task, for a cohort of any size.
    """
    patients = notes.select("SUBJECT_ID").distinct()
    if num_patients is None:
        return patients
    ordered = patients.withColumn("_missing", F.col("SUBJECT_ID").isNull())
    numbered = number_sorted(ordered, ["_missing", "SUBJECT_ID"], "_nth")
    return numbered.filter(F.col("_nth") <= num_patients).select("SUBJECT_ID")


def restrict_to_cohort(df: DataFrame, cohort: DataFrame) -> DataFrame:
    """Rows of the cohort's patients.

    There is no hint: Spark sends a small cohort along, and for a larger one joins by a
    shuffle, where adaptive execution splits a patient with many rows.
    """
    return df.join(cohort, "SUBJECT_ID", "left_semi")

"""Codes gathered into ordered lists.

The list is the result: one cell per admission, holding that admission's codes and no
others. Lists do not shrink when they are combined early, so the rows are shuffled as they
are and gathered once, instead of being sorted and listed on the map side as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeprep.config import DatasetVersion, dataset_version

ADMISSION = ("SUBJECT_ID", "HADM_ID")


def _entries(*last: Column) -> Column:
    """All rows of the group by sequence number (missing ones last), then by ``last``."""
    seq = F.col("SEQ_NUM")
    return F.sort_array(
        F.collect_list(F.struct(seq.isNull().alias("unnumbered"), seq.alias("seq"), *last))
    )


def _codes(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["code"])


def group_codes(
    codes: DataFrame,
    version: str | DatasetVersion,
    out: str,
    keys: Sequence[str] = ADMISSION,
) -> DataFrame:
    """One list per key, ordered by sequence number then code; missing codes are left out."""
    v = dataset_version(version)
    if "SEQ_NUM" not in codes.columns:
        codes = codes.withColumn("SEQ_NUM", F.lit(None).cast("int"))
    return (
        codes.filter(F.col(v.code_col).isNotNull())
        .repartition(*keys)
        .groupBy(*keys)
        .agg(_codes(_entries(F.col(v.code_col).alias("code"))).alias(out))
    )


def admission_codes(
    diagnoses: DataFrame,
    procedures: DataFrame,
    version: str | DatasetVersion,
    keys: Sequence[str] = ADMISSION,
) -> DataFrame:
    """Both lists per admission in a single shuffle; admissions without a diagnosis drop out.

    The notes meet the diagnoses by an inner join and the procedures by a left join on
    the same key, so one aggregation over both tables and one join give the same rows.
    ``keys`` may name further columns that both tables carry.
    """
    v = dataset_version(version)

    def tagged(df: DataFrame, diagnosis: bool) -> DataFrame:
        return df.filter(F.col(v.code_col).isNotNull()).select(
            *keys,
            "SEQ_NUM",
            F.col(v.code_col).alias("code"),
            F.lit(diagnosis).alias("diagnosis"),
        )

    both = tagged(diagnoses, True).unionByName(tagged(procedures, False))
    entries = F.col("_entries")
    return (
        both.repartition(*keys)
        .groupBy(*keys)
        .agg(_entries(F.col("code"), F.col("diagnosis")).alias("_entries"))
        .filter(F.exists(entries, lambda e: e["diagnosis"]))
        .select(
            *keys,
            _codes(F.filter(entries, lambda e: e["diagnosis"])).alias("diagnosis_codes"),
            _codes(F.filter(entries, lambda e: ~e["diagnosis"])).alias("procedure_codes"),
        )
    )

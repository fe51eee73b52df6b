"""The clinical tables, read out of the general test tables.

Two documents make the notes of one order, which stands for an admission; its customer is
the patient. Line items stand for codes: status F for diagnoses, O for procedures.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeprep.config import MIMIC_III, DatasetVersion, dataset_version


# Declared columns, so that opening a table needs no job to read its footer.
COLUMNS = {
    "documents": "doc_id bigint, text string, lang string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_linestatus string",
    "customer": "c_custkey bigint",
    "part": "p_partkey bigint, p_name string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{folder}/{name}.parquet")


def code_text(key: Column) -> Column:
    return F.lpad(key.cast("string"), 5, "0")


@dataclass(frozen=True)
class ClinicalTables:
    version: DatasetVersion
    notes: DataFrame
    diagnoses: DataFrame
    procedures: DataFrame
    patients: DataFrame


def clinical_tables(
    spark: SparkSession, folder: str, version: str | DatasetVersion = MIMIC_III
) -> ClinicalTables:
    v = dataset_version(version)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    documents = table(spark, folder, "documents").withColumn(
        "o_orderkey", F.expr("doc_id div 2")
    )
    english = F.col("lang") == "en"
    if v is MIMIC_III:
        key = F.col("doc_id")
        kind = F.when(english, "Discharge summary").otherwise("Radiology")
    else:
        key = F.concat(F.col("o_custkey").cast("string"), F.lit("-DS-"), F.col("doc_id"))
        kind = F.when(english, "DS").otherwise("RR")
    notes = documents.join(orders, "o_orderkey").select(
        key.alias(v.note_key),
        F.col("o_custkey").alias("SUBJECT_ID"),
        F.col("o_orderkey").alias("HADM_ID"),
        kind.alias(v.kind_col),
        F.col("text").alias("TEXT"),
    )
    items = table(spark, folder, "lineitem")

    def codes(status: str) -> DataFrame:
        return (
            items.filter(F.col("l_linestatus") == status)
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("o_custkey").alias("SUBJECT_ID"),
                F.col("l_orderkey").alias("HADM_ID"),
                F.col("l_linenumber").alias("SEQ_NUM"),
                code_text(F.col("l_partkey")).alias(v.code_col),
            )
        )

    patients = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("SUBJECT_ID"),
        F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("GENDER"),
    )
    return ClinicalTables(v, notes, codes("F"), codes("O"), patients)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as the pages of documents."""
    return table(spark, folder, "conversations").select(
        "conv_id", F.col("turn").alias("page_no"), "text"
    )


def dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as code descriptions."""
    return table(spark, folder, "part").select(
        code_text(F.col("p_partkey")).alias("code"), F.col("p_name").alias("description")
    )

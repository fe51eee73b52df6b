"""Single dataset files and the CSV-only path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeprep.config import DatasetVersion, dataset_version
from codeprep.operators.examples import examples_by_admission
from codeprep.operators.joins import hot_keys
from codeprep.operators.numbering import FILE, ROW, number_placed
from codeprep.sources.paths import require, under
from codeprep.sources.tables import read_csv_table
from codeprep.staging import placed, staged


def load_dataset(
    spark: SparkSession, path: str, schema: StructType | None = None, lines: bool = False
) -> DataFrame:
    """A ``.csv`` or ``.json`` file (or folder of that name).

    JSON holds an array of records per file; with ``lines`` it holds one record per line,
    which lets Spark split large files. Without a ``schema`` Spark reads the data once more
    to infer one; give it for large files, and wherever codes have leading zeros.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in ("csv", "json"):
        require(spark, path)
        raise ValueError(f"{path} is neither .csv nor .json")
    require(spark, path)
    reader = spark.read.option("multiLine", not lines)
    if schema is not None:
        reader = reader.schema(schema)
    if suffix == "json":
        return reader.json(path)
    if schema is None:
        reader = reader.option("inferSchema", True)
    return reader.option("header", True).option("escape", '"').csv(path)


def load_csv_examples(
    spark: SparkSession,
    folder: str,
    version: str | DatasetVersion = "mimic-iv",
    notes_table: str | None = None,
    codes_table: str | None = None,
) -> DataFrame:
    """Examples straight from a notes CSV and a diagnoses CSV, matched by admission."""
    v = dataset_version(version)
    notes = read_csv_table(spark, under(folder, notes_table or v.csv_notes), multiline=True)
    codes = read_csv_table(spark, under(folder, codes_table or v.csv_codes))
    # Parsed once: the notes are read for their keys and again for their texts.
    lines = number_placed(placed(staged(notes, "csv-notes"), FILE, ROW), "_line")
    lines = lines.select("_line", "HADM_ID", "SUBJECT_ID", v.kind_col, "TEXT")
    hot = staged(hot_keys(lines.filter(F.col("HADM_ID") != 0), ["HADM_ID"]), "hot-admissions")
    return examples_by_admission(lines, codes, v, "_line", hot=hot)

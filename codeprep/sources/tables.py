"""Raw CSV tables and their Parquet copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from codeprep.config import DatasetVersion, TableLayout, dataset_version
from codeprep.operators.audit import require_unique
from codeprep.schemas import RAW_TYPES
from codeprep.sources.paths import exists, require, under
from codeprep.sources.quoted_csv import PLACE, read_quoted
from codeprep.staging import remove

REJECTED = "_rejected"


def upper_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def number_of(text: Column, kind: DataType) -> Column:
    """A whole number from its text, also in the form ``163353.0``; null if it is none."""
    trimmed = F.trim(text)
    whole = F.regexp_extract(trimmed, r"^([+-]?[0-9]+)(?:\.0*)?$", 1)
    return whole.try_cast(kind)


def typed(df: DataFrame) -> DataFrame:
    """Cast the known columns; codes and unknown columns stay text.

    A value that is neither blank nor a whole number becomes null, and its row is marked in
    a further column ``REJECTED`` with the names of such columns.
    """
    numbers = [c for c in df.columns if c in RAW_TYPES]
    found = {c: number_of(F.col(c), RAW_TYPES[c]) for c in numbers}
    wrong = [
        F.when((F.trim(F.col(c)) != "") & found[c].isNull(), F.lit(c)) for c in numbers
    ]
    marks = F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>")
    columns = [found[c].alias(c) if c in found else F.col(c) for c in df.columns]
    return df.select(*columns, F.when(F.size(marks) > 0, F.concat_ws(",", marks)).alias(REJECTED))


def read_csv_table(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A CSV file, or a folder of them, as a typed table with upper-case names.

    All fields are read as text and matched by header name, so no pass over the data
    guesses types and leading zeros survive. Only tables with line breaks inside quotes
    need ``multiline``. Either way one large file is read by many tasks. Numbers that are
    none become null; ``ingest`` sets such rows aside.
    """
    return typed(raw_csv_table(spark, path, multiline)).drop(REJECTED)


def raw_csv_table(
    spark: SparkSession, path: str, multiline: bool, placed: bool = False
) -> DataFrame:
    """All fields as text, with upper-case names.

    With ``placed`` a table with line breaks has the columns ``quoted_csv.PLACE`` too.
    """
    require(spark, path)
    options = {"quote": '"', "escape": '"'}
    raw = spark.read.options(**options, header=True, multiLine=multiline).csv(path)
    if not multiline:
        return upper_columns(raw)
    found = read_quoted(spark, path, raw.schema, options)
    values = upper_columns(found.drop(*PLACE)).columns
    return found.toDF(*PLACE, *values) if placed else found.drop(*PLACE).toDF(*values)


def ingest(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    version: str | DatasetVersion,
    overwrite: bool = False,
) -> dict[str, DataFrame]:
    """Turn the version's CSV tables into Parquet, once.

    A table that is already there is kept unless ``overwrite`` is set. Patients are
    checked for uniqueness, since a duplicate would multiply rows of the fact table. Rows
    with a number that is none are not lost: they are written beside the table as they
    came (``reject_path``).
    """
    v = dataset_version(version)
    require(spark, raw_dir)
    for name, table in v.layout.items():
        _ingest_one(spark, raw_dir, table_path(out_dir, v, name), name, table, overwrite, v)
    return read_tables(spark, out_dir, v)


def _ingest_one(
    spark: SparkSession,
    raw_dir: str,
    target: str,
    name: str,
    table: TableLayout,
    overwrite: bool,
    version: DatasetVersion,
) -> None:
    source = require(spark, under(raw_dir, table.path))
    if not overwrite and exists(spark, under(target, "_SUCCESS")):
        return
    raw = raw_csv_table(spark, source, table.multiline, placed=table.multiline)
    if table.multiline:
        # Notes without a key are numbered by their place, so they are written in that order.
        keyed = version.note_key in raw.columns
        ordered = raw if keyed else raw.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE)
        raw = ordered.drop(*PLACE)
    df = typed(raw)
    if name == "PATIENTS":
        require_unique(df.filter(F.col(REJECTED).isNull()), ["SUBJECT_ID"], name)
    seen = Observation()
    marked = df.observe(seen, F.count(REJECTED).alias("rejected"))
    good = marked.filter(F.col(REJECTED).isNull()).drop(REJECTED)
    # Rows are counted before the filter, in the pass that writes the table.
    good.write.mode("overwrite").option("compression", "zstd").parquet(target)
    aside = f"{target}_rejected"
    if seen.get["rejected"]:
        numbers = [c for c in raw.columns if c in RAW_TYPES]
        kept = raw.withColumns({f"{c}_AS_TEXT": F.col(c) for c in numbers})
        bad = typed(kept).filter(F.col(REJECTED).isNotNull())
        bad.write.mode("overwrite").parquet(aside)
    elif exists(spark, aside):
        remove(spark, aside)


def reject_path(out_dir: str, version: str | DatasetVersion, name: str) -> str:
    """Where the rows of a table lie that could not be read; absent if there are none."""
    return f"{table_path(out_dir, version, name)}_rejected"


def table_path(out_dir: str, version: str | DatasetVersion, name: str) -> str:
    return under(out_dir, f"{dataset_version(version).database}/{name.lower()}")


def read_tables(
    spark: SparkSession, out_dir: str, version: str | DatasetVersion
) -> dict[str, DataFrame]:
    """The ingested tables by name."""
    v = dataset_version(version)
    return {
        name: spark.read.parquet(require(spark, table_path(out_dir, v, name)))
        for name in v.layout
    }

"""Note filters and note keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeprep.config import DatasetVersion, dataset_version
from codeprep.operators.numbering import number_sorted


def discharge_notes(notes: DataFrame, version: str | DatasetVersion) -> DataFrame:
    """Discharge notes only; the comparison reaches the Parquet scan."""
    v = dataset_version(version)
    return notes.filter(F.col(v.kind_col) == F.lit(v.discharge_kind))


def with_note_key(
    notes: DataFrame, version: str | DatasetVersion, position: Sequence[str]
) -> DataFrame:
    """Keep the note key, or number the notes from 1 in the order of ``position``.

    ``position`` must identify a row. For a Parquet table read from files,
    ``sources.tables.with_file_order_key`` numbers by file position without a shuffle.
    """
    v = dataset_version(version)
    if v.note_key in notes.columns:
        return notes
    return number_sorted(notes, position, v.note_key)

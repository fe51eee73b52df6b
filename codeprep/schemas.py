"""Column types of the raw tables. Columns not named here are kept as text."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_TYPES = {
    "SUBJECT_ID": T.LongType(),
    "HADM_ID": T.LongType(),
    "NOTE_PK": T.LongType(),
    "SEQ_NUM": T.IntegerType(),
}

CODES = T.ArrayType(T.StringType())
TOKENS = T.ArrayType(T.IntegerType())

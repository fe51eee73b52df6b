"""Prediction output as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_results(df: DataFrame, path: str | None = None, compression: str | None = None) -> None:
    """Write JSON lines under ``path``, or print every row, one partition at a time.

    ``compression`` names a codec of Spark's JSON writer; field names and descriptions repeat,
    so files of many records shrink to a fraction.
    """
    if path is not None:
        df.write.mode("overwrite").json(path, compression=compression)
        return
    for row in df.select(F.to_json(F.struct("*")).alias("json")).toLocalIterator():
        print(json.dumps(json.loads(row["json"]), indent=2))

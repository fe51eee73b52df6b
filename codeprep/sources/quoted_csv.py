"""CSV files with line breaks inside quotes, each read by many tasks.

A quote that is part of a value is doubled, so every quote of a well-formed file opens or
closes a value, and a line ends a record exactly when an even number of quotes has come
before. Files are read as lines, freely split. The quotes of each split are counted; the
prefix sum of these counts along a file tells with what parity a split begins. Each task then
cuts its lines into records by itself. A record that goes on into the next splits is put
together from its parts, of which a split has two at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeprep.staging import staged

# What a row holds: a record, the part of one that ends, fills or begins in a split, a header.
RECORD, END, MIDDLE, BEGIN, HEADER = range(5)
PLACE = ["_file", "_split", "_seq"]


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _split, line): the lines of a file or folder with the split they begin in.

    Lines end with a line feed alone, so that carriage returns inside quotes stay.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.col("value").alias("line"),
    )


def split_states(lines: DataFrame) -> DataFrame:
    """(_file, _split, inside): whether a split begins inside quotes. One row per split."""
    quotes = F.octet_length("line") - F.octet_length(F.replace("line", F.lit('"'), F.lit("")))
    counts = lines.groupBy("_file", "_split").agg(F.sum(quotes).alias("n"))
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        "_file", "_split", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2).alias("inside")
    )


class _Split:
    """The lines of one split in turn; gives records and parts of records."""

    def __init__(self, file: str, start: int, inside: int):
        self.file, self.start, self.parity = file, start, inside
        self.opened = not inside  # whether a record has begun in this split
        self.header = start == 0 and not inside  # the first record of a file is still to come
        self.open: list[pa.Array] = []
        self.seq = 0

    def take(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
        parity = (self.parity + np.cumsum(quotes)) & 1
        self.parity = int(parity[-1])
        ends = np.flatnonzero(parity == 0) + 1
        if not len(ends):
            self.open.append(lines)
            return
        first = joined(pa.concat_arrays([*self.open, lines.slice(0, int(ends[0]))]), [0, -1])
        yield from self.rows(first, RECORD if self.opened else END)
        self.opened = True
        if len(ends) > 1:
            yield from self.rows(joined(lines, ends), RECORD)
        rest = lines.slice(int(ends[-1]))
        self.open = [rest] if len(rest) else []

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            part = joined(pa.concat_arrays(self.open), [0, -1])
            yield from self.rows(part, BEGIN if self.opened else MIDDLE)
        self.open = []

    def rows(self, values: pa.Array, kind: int) -> Iterator[pa.RecordBatch]:
        if kind == RECORD:
            raw = values
            bare = pc.if_else(pc.ends_with(values, "\r"), pc.binary_slice(values, 0, -1), values)
            filled = pc.not_equal(pc.binary_length(bare), 0)
            values = bare.filter(filled)
            if self.header and len(values):
                self.header = False
                yield from self.rows(raw.filter(filled).slice(0, 1), HEADER)
                values = values.slice(1)
        n = len(values)
        if n:
            seq = np.arange(self.seq, self.seq + n)
            self.seq += n
            columns = [
                pa.array([self.file] * n),
                pa.array(np.full(n, self.start)),
                pa.array(seq),
                pa.array(np.full(n, kind, np.int32)),
                values,
            ]
            yield pa.RecordBatch.from_arrays(columns, [*PLACE, "kind", "value"])


def joined(lines: pa.Array, bounds: list[int] | np.ndarray) -> pa.Array:
    """Lines put together between each two bounds; the last bound may be -1, the end."""
    ends = [len(lines) if b < 0 else int(b) for b in bounds]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines)
    return pc.binary_join(lists, pa.scalar(b"\n", lines.type))


def pieces_of_records(lines: DataFrame) -> DataFrame:
    """(_file, _split, _seq, kind, value) of a table of lines with the state of their split."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: _Split | None = None
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                file, start = batch.column("_file")[at].as_py(), batch.column("_split")[at].as_py()
                other = (batch.column("_split").to_numpy()[at:] != start) | pc.not_equal(
                    batch.column("_file").slice(at), file
                ).to_numpy(zero_copy_only=False)
                end = at + int(other.argmax()) if other.any() else batch.num_rows
                if split is None or (split.file, split.start) != (file, start):
                    if split is not None:
                        yield from split.close()
                    split = _Split(file, start, batch.column("inside")[at].as_py())
                yield from split.take(batch.column("line").slice(at, end - at))
                at = end
        if split is not None:
            yield from split.close()

    given = lines.select("_file", "_split", "inside", F.col("line").cast("binary").alias("line"))
    kind = "_file string, _split bigint, _seq bigint, kind int, value binary"
    return given.mapInArrow(scan, kind)


def across_splits(parts: DataFrame) -> DataFrame:
    """The records that begin in one split and end in another, at the place where they begin.

    Parts are told apart without their values first: one narrow row per part.
    """
    order = Window.partitionBy("_file").orderBy("_split", "_seq")
    narrow = parts.select(*PLACE, F.sum((F.col("kind") == BEGIN).cast("int")).over(order).alias("record"))
    whole = parts.join(narrow, PLACE).groupBy("_file", "record").agg(
        F.min(F.struct("_split", "_seq")).alias("at"),
        F.array_sort(F.collect_list(F.struct("_split", "_seq", "value"))).alias("parts"),
    )
    text = F.concat_ws("\n", F.transform("parts", lambda p: p["value"].cast("string")))
    whole = whole.select("_file", "at.*", text.alias("text"))
    bare = F.when(F.endswith("text", F.lit("\r")), F.expr("left(text, length(text) - 1)"))
    return whole.select(*PLACE, F.coalesce(bare, "text").alias("value"))


def read_quoted(spark: SparkSession, path: str, schema: StructType, options: dict[str, str]) -> DataFrame:
    """Records of CSV files with a header as rows of ``schema`` (all text), with their ``PLACE``.

    ``PLACE`` orders them as the files do. The rows are those of a read with ``multiLine`` if
    quotes stand only around values and, doubled, inside quoted ones; a quote in the middle
    of a bare value is taken for an opening one. A value that is never closed ends with its
    file. The records are written once to the scratch folder.
    """
    lines = split_lines(spark, path)
    # The states are one small row per split, and the lines must keep their order.
    known = lines.join(F.broadcast(split_states(lines)), ["_file", "_split"])
    found = staged(pieces_of_records(known), "records")
    records = found.filter(F.col("kind") == RECORD).select(*PLACE, F.col("value").cast("string"))
    parts = found.filter(F.col("kind").isin(END, MIDDLE, BEGIN))
    records = records.unionByName(across_splits(parts))
    # Where the header ends with both characters, a line break is one in the values too.
    both = found.filter((F.col("kind") == HEADER) & F.col("value").cast("string").endswith("\r"))
    both = both.select("_file", F.lit(True).alias("_both"))
    records = records.join(F.broadcast(both), "_file", "left")
    value = F.when(F.col("_both"), F.replace("value", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("value"))
    row = parsed(value, schema, options)
    return records.select(*PLACE, row.alias("_row")).select(*PLACE, "_row.*")


def parsed(value: Column, schema: StructType, options: dict[str, str]) -> Column:
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)
    return F.from_csv(value, F.lit(ddl), options)

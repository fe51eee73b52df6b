"""Descriptions for lists of codes.

A code's descriptions travel once for each block of rows that needs them, and not once for each
place where the code stands: a dictionary with many rows for a code would otherwise be shuffled
as often as its codes occur. The records of a row are put together in the task that holds its
block, a few rows at a time, so they are neither shuffled nor spilled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeprep.config import NO_DESCRIPTION
from codeprep.functions import codes as C
from codeprep.operators.numbering import number_placed
from codeprep.staging import staged_rows

# Entries of a block, whose descriptions one task holds; rows of the smallest blocks, into which
# a small table is cut to keep all cores busy; bytes of records handed back at once.
BLOCK_ENTRIES = 1 << 21
LEAST_ROWS = 8_192
RECORD_BYTES = 8 << 20


def describe_codes(
    df: DataFrame,
    keys: Sequence[str],
    dictionary: DataFrame,
    codes: str = "codes",
    out: str = "predictions",
) -> DataFrame:
    """Add ``{code, description}`` per entry, in the order of the list.

    One row per row of ``df``, whether or not ``keys`` are unique. ``df`` is written once to the
    scratch folder, and a row's block follows from its place there, which a task that runs again
    finds the same. ``dictionary`` holds one row per code (``code``, ``description``); a code
    with several gives one record for each, in order of the descriptions. It carries no
    broadcast hint: only the codes and blocks that need them are joined to it. Rows without
    codes ask for nothing and stay in their block.
    """
    keys = list(keys)
    columns = [*keys, *[c for c in df.columns if c not in keys]]
    written = staged_rows(df, "undescribed")
    rows, blocks = in_blocks(written, codes)
    needed = (
        rows.select("_block", F.explode(C.or_empty(F.col(codes))).alias("_code"))
        .filter(F.col("_code").isNotNull())
        .distinct()
    )
    told = dictionary.filter(F.col("code").isNotNull()).select(
        "code", F.coalesce("description", F.lit(NO_DESCRIPTION)).alias("description")
    )
    # The texts of a code one after the other, and the bytes of each.
    texts = F.array_sort(F.collect_list("description"))
    lists = told.repartition("code").groupBy("code").agg(texts.alias("_texts"))
    lists = lists.select(
        "code",
        F.array_join("_texts", "").alias("_text"),
        F.transform("_texts", lambda t: F.octet_length(t)).alias("_sizes"),
    )
    values = needed.join(lists, F.col("_code") == F.col("code")).drop("code")
    both = rows.select("_block", F.lit(True).alias("_is_row"), *columns).unionByName(
        values.withColumn("_is_row", F.lit(False)), allowMissingColumns=True
    )
    dealt = both.repartitionById(blocks, F.col("_block")).sortWithinPartitions("_is_row")
    entry = df.schema[codes].dataType.elementType
    record = T.StructType().add("code", entry).add("description", T.StringType())
    kind = T.StructType([T.StructField(c, df.schema[c].dataType) for c in columns])
    return dealt.mapInArrow(_teller(columns, codes, out), kind.add(out, T.ArrayType(record)))


def in_blocks(written: DataFrame, codes: str) -> tuple[DataFrame, int]:
    """Rows with the number of their block in ``_block``, and how many blocks there are.

    A block is a run of rows in file order, so a task of the next step meets few of them.
    """
    sizes = written.agg(F.count(F.lit(1)), F.sum(F.greatest(F.size(codes), F.lit(1)).cast("bigint")))
    n, entries = sizes.collect()[0]
    busy = min(4 * written.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS))
    blocks = max(-(-(entries or 0) // BLOCK_ENTRIES), busy, 1)
    each = max(-(-n // blocks), 1)
    rows = number_placed(written, "_number", start=0)
    return rows.withColumn("_block", F.expr(f"int(_number div {each}L)")).drop("_number"), blocks


def _teller(columns: list[str], codes: str, out: str) -> Callable:
    """From the values of a block, then its rows, to the rows with their records."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        known = None
        for batch in batches:
            values = batch.num_rows - pc.sum(batch["_is_row"], min_count=0).as_py()
            if values:
                held.append(batch.slice(0, values).select(["_code", "_text", "_sizes"]))
            if values == batch.num_rows:
                continue
            if known is None:
                # Values come first: from the first row on the block's are complete.
                known = _descriptions(held, batch["_code"].type)
                held.clear()
            yield from _described(batch.slice(values).select(columns), codes, out, *known)

    return tell


def _descriptions(held: list[pa.RecordBatch], kind: pa.DataType) -> tuple[pa.Array, pa.ListArray]:
    """The codes of a block and their descriptions; one list more is for all other codes."""
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        asked, text, sizes = (table[c].chunk(0) for c in ("_code", "_text", "_sizes"))
        body = b"".join(_bytes(c) for c in table["_text"].chunks)
        lengths, counts = sizes.flatten().to_numpy(), pc.list_value_length(sizes).to_numpy()
    else:
        asked, body = pa.array([], kind), b""
        lengths = counts = np.array([], np.int32)
    other = NO_DESCRIPTION.encode()
    ends = np.cumsum(np.concatenate(([0], lengths, [len(other)])), dtype=np.int64)
    at = np.cumsum(np.concatenate(([0], counts, [1])), dtype=np.int64)
    texts = pa.LargeStringArray.from_buffers(
        len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(body + other)
    )
    return asked, pa.LargeListArray.from_arrays(pa.array(at), texts)


def _bytes(texts: pa.Array) -> bytes:
    """The texts of an array one after the other."""
    return b"".join(texts.cast(pa.binary()).to_pylist())


def _described(
    rows: pa.RecordBatch, codes: str, out: str, asked: pa.Array, told: pa.LargeListArray
) -> Iterator[pa.RecordBatch]:
    """``rows`` with their records, in batches of a bounded size."""
    lists = rows[codes]
    entries = lists.flatten()
    found = pc.fill_null(pc.index_in(entries, value_set=asked), len(asked)).to_numpy()
    starts = np.cumsum(np.concatenate(([0], pc.fill_null(pc.list_value_length(lists), 0))))
    at = told.offsets.to_numpy()
    counts = np.diff(at)[found]
    first = np.cumsum(np.concatenate(([0], counts)))[starts]
    # Bytes of the records before each entry, then before each row.
    ends = np.frombuffer(told.values.buffers()[1], np.int64)
    widths = np.diff(ends[at])[found] + 16 * counts
    before = np.cumsum(np.concatenate(([0], widths)))[starts]
    a = 0
    while a < rows.num_rows:
        b = int(np.searchsorted(before, before[a] + RECORD_BYTES, "right")) - 1
        b = min(max(b, a + 1), rows.num_rows)
        part = slice(starts[a], starts[b])
        code = entries.take(pa.array(np.repeat(np.arange(starts[a], starts[b]), counts[part])))
        description = told.take(pa.array(found[part])).flatten().cast(pa.string())
        records = pa.StructArray.from_arrays([code, description], ["code", "description"])
        offsets = pa.array((first[a : b + 1] - first[a]).astype(np.int32))
        arrays = [*rows.slice(a, b - a).columns, pa.ListArray.from_arrays(offsets, records)]
        yield pa.RecordBatch.from_arrays(arrays, [*rows.schema.names, out])
        a = b

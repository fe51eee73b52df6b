"""Look-ups of corpus-wide values by the tasks that need them, a block of documents at a time.

A block is a bounded number of documents together with the distinct keys in them, in order.
Documents hold their keys as places in that list. The values of a block's keys come before
its documents in one sorted partition, so a task holds those of one block and no table of all
keys, and each key crosses the network once per block and not once per occurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeprep.llm.memory import releasing

# A task numbers its blocks after its own number times this.
BLOCKS_PER_TASK = 1 << 24


def first_block() -> int:
    """The number of a task's first block. The table must be written before it is used."""
    return TaskContext.get().partitionId() * BLOCKS_PER_TASK


def with_values(
    documents: DataFrame,
    values: DataFrame,
    use: Callable[[pa.RecordBatch | None, pa.RecordBatch], pa.RecordBatch],
    kind: str,
) -> DataFrame:
    """``use`` on batches of documents, each with the values of its block in order of ``spot``.

    Both tables have a column ``block``; that of the values also ``spot``. ``use`` gets all
    values of the block (None if there are none) and some of its documents, as batches whose
    columns are those of both tables.
    """
    docs = documents.withColumn("rank", F.lit(1)).withColumn("spot", F.lit(0))
    rows = docs.unionByName(values.withColumn("rank", F.lit(0)), allowMissingColumns=True)

    @releasing
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, whole = None, [], None
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                block, rank = batch.column("block")[at], batch.column("rank")[at]
                if block != now:
                    now, held, whole = block, [], None
                end = run_end(batch, at)
                part = batch.slice(at, end - at)
                at = end
                if rank.as_py() == 0:
                    held.append(part)
                    continue
                if held:
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                yield use(whole, part)

    sorted_ = rows.repartition("block").sortWithinPartitions("block", "rank", "spot")
    return sorted_.mapInArrow(stream, kind)


def run_end(batch: pa.RecordBatch, at: int) -> int:
    """The end of the rows with the block and rank of row ``at``."""
    blocks = batch.column("block").to_numpy(zero_copy_only=False)[at:]
    ranks = batch.column("rank").to_numpy(zero_copy_only=False)[at:]
    other = (blocks != blocks[0]) | (ranks != ranks[0])
    return at + int(other.argmax()) if other.any() else batch.num_rows

"""Which keys occur at two or more places, without gathering the rows of a key.

Producers hand rows (key, a, b, extras) to a ``Flusher`` inside their task. It looks at a
bounded number of rows at a time: where a key occurs twice among them, all its rows are
``known`` to repeat, one of them stands for the key and the rest are dealt out at random.
So a key that holds a third of all rows sends one row per flush to the key's task.
``repeated`` then sorts each partition by key and streams over it with one row of state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeprep.llm.grams import mix
from codeprep.llm.memory import releasing

# Rows that one task looks at together: 8 bytes a column, some 40 MB with all copies.
FLUSH_ROWS = 250_000


def schema(extras: Sequence[str] = ()) -> str:
    names = ["deal", "key", "a", "b", *extras]
    return ", ".join(f"{n} bigint" for n in names) + ", known boolean"


class Flusher:
    """Collects (key, a, b, extras) arrays; no (key, a, b) may be added twice in one flush."""

    def __init__(self, extras: Sequence[str] = ()):
        self.names = ["key", "a", "b", *extras]
        self.parts: list[list[np.ndarray]] = []
        self.rows = 0

    def add(self, *columns: np.ndarray) -> bool:
        """Take one document's rows; true when it is time to flush."""
        self.parts.append([c.astype(np.int64, copy=False) for c in columns])
        self.rows += len(columns[0])
        return self.rows >= FLUSH_ROWS

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            self.parts, self.rows = [], 0
            order = np.argsort(columns[0], kind="stable")
            columns = [c[order] for c in columns]
            key = columns[0]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            last = np.append(first[1:], True)
            known = ~(first & last)
            place = mix(columns[1].view(np.uint64) * np.uint64(31) + columns[2].view(np.uint64))
            deal = np.where(first, key, place.view(np.int64))
            out = [deal, *columns, known]
            for at in range(0, len(key), 50_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[at : at + 50_000]) for c in out], ["deal", *self.names, "known"]
                )


def repeated(rows: DataFrame, extras: Sequence[str] = ()) -> DataFrame:
    """Distinct (key, a, b, extras) whose key occurs with two or more different (a, b)."""
    names = ["key", "a", "b", *extras]

    @releasing
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # last row: columns, whether it repeats, is out
        held_known = held_out = False
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            known = batch.column("known").to_numpy(zero_copy_only=False)
            done = np.zeros(len(known), bool)
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
                known = np.concatenate([[held_known], known])
                done = np.concatenate([[held_out], done])
            key, a, b = columns[:3]
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            new_row = new_key.copy()
            new_row[1:] |= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            starts = np.flatnonzero(new_key)
            places = np.add.reduceat(new_row.astype(np.int64), starts)
            repeats = (places > 1) | np.logical_or.reduceat(known, starts)
            sizes = np.diff(np.append(starts, len(key)))
            # A row that came with the batch before is the first of its kind here.
            out = np.repeat(repeats, sizes) & new_row & ~done
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in columns], names)
            held = [c[-1:] for c in columns]
            held_known = bool(repeats[-1])
            held_out = bool(repeats[-1])
        if held is not None and held_known and not held_out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names)

    dealt = rows.repartition(F.col("deal")).sortWithinPartitions("key", "a", "b")
    kind = ", ".join(f"{n} bigint" for n in names)
    return dealt.select(*names, "known").mapInArrow(stream, kind)

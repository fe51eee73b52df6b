"""Token ids in training order: a keyed permutation of slots, written as fixed-stride shards.

All documents, each closed by an end token, form one stream in the order of their ids. It is
cut into sequences of equal length. A Feistel network over just enough bits, walked until it
falls below the number of sequences, gives every sequence its slot: a permutation that any
worker computes for itself. A shard holds a fixed range of slots as one block of bytes, so
slot s lies in shard s // shard_size at byte (s % shard_size) * length * 2.

Shards are dealt to tasks by ranges of slots. The slots have no gaps, so the ranges are
known beforehand and nothing is sampled. Each range is one folder named after the first slot
behind it, with one file in slot order and one row group per shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeprep.llm.grams import mix
from codeprep.llm.ordering import order_buckets
from codeprep.llm.stage import stage
from codeprep.llm.tokenizer import RANKS, Encoder, read_ranks
from codeprep.staging import scratch_path

LENGTH = 512
SHARD_SEQUENCES = 1_024
END = 50_256
FEISTEL_ROUNDS = 6
BUCKET_ROWS = 50_000
# At most so many shards, of a megabyte each as registered, lie in one range.
RANGE_SHARDS = 128
BYTES = 2


def slots(numbers: np.ndarray, total: int, key: int) -> np.ndarray:
    """The slot of each sequence number below ``total``; a permutation for every key."""
    half = max(1, -(-max(total - 1, 1).bit_length() // 2))
    low = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    seeds = [
        mix(np.array([key * FEISTEL_ROUNDS + r], np.uint64) + np.uint64(1))[0]
        for r in range(FEISTEL_ROUNDS)
    ]
    out = numbers.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> shift, out[walk] & low
        for seed in seeds:
            left, right = right, left ^ (mix(mix(right + seed) + seed) & low)
        out[walk] = (left << shift) | right
        walk = walk[out[walk] >= total]
    return out.astype(np.int64)


def tokenised(docs: DataFrame, ident: str, text: str, ranks: dict[bytes, int]) -> DataFrame:
    """(bucket, inside, n, tokens) in id order: the ids of each text with the end token.

    ``inside`` is how many tokens lie before in the same bucket, a range of ids of some
    ``BUCKET_ROWS`` documents. The tokens cross one shuffle to their bucket's task, are
    sorted by id (null first), then by the hash of the tokens, and written. Bytes that are
    no UTF-8 count as U+FFFD.
    """

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(ranks)
        end = np.array([END], "<u2").tobytes()
        for texts in batches:
            bodies = ((t.as_py() or b"").decode("utf-8", "replace") for t in texts)
            yield pa.array([encoder.ids(b) + end for b in bodies], pa.binary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = None, 0
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            sizes = pc.binary_length(batch.column("tokens")).to_numpy().astype(np.int64) // BYTES
            sums = np.cumsum(sizes) - sizes
            starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]][: len(buckets)])
            inside = sums - np.repeat(sums[starts], np.diff(np.append(starts, len(sums))))
            if len(buckets):
                if buckets[0] == now:
                    inside[buckets == now] += before
                now, before = buckets[-1], int(inside[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("bucket"), pa.array(inside), pa.array(sizes), batch.column("tokens")],
                ["bucket", "inside", "n", "tokens"],
            )

    _, bucket = order_buckets(docs.select(F.col(ident).alias("id")), "id", BUCKET_ROWS)
    found = docs.select(F.col(ident).alias("id"), encode(F.col(text).cast("binary")).alias("tokens"))
    found = found.select(
        bucket.cast("long").alias("bucket"), "id", F.xxhash64("tokens").alias("tie"), "tokens"
    )
    order = ["bucket", F.asc_nulls_first("id"), "tie"]
    dealt = found.repartition("bucket").sortWithinPartitions(*order).select("bucket", "tokens")
    return stage(dealt.mapInArrow(count, "bucket bigint, inside bigint, n bigint, tokens binary"), "tokens")


def with_offsets(rows: DataFrame) -> DataFrame:
    """(offset, tokens): where each document begins in the whole stream.

    Only the sums of buckets, one row per ``BUCKET_ROWS`` documents, are added up in one
    task and joined, without a hint.
    """
    sums = rows.groupBy("bucket").agg(F.sum("n").alias("_sum"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    placed = rows.join(stage(bases, "bases"), "bucket")
    return placed.select((F.col("_base") + F.col("inside")).alias("offset"), "tokens")


def pieces(rows: DataFrame, total: int, length: int, key: int, shard: int) -> DataFrame:
    """(shard, slot, at, sequence, data): each document's tokens cut at sequence ends."""
    sequences = -(-total // length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = batch.column("offset").to_numpy()
            tokens = batch.column("tokens")
            stop = begin + pc.binary_length(tokens).to_numpy().astype(np.int64) // BYTES
            first = begin // length
            count = (stop - 1) // length - first + 1
            row = np.repeat(np.arange(len(begin)), count)
            numbers = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            starts = np.maximum(numbers * length, begin[row])
            ends = np.minimum((numbers + 1) * length, stop[row])
            where = slots(numbers, sequences, key)
            bodies = tokens.to_pylist()
            froms, tos = (starts - begin[row]) * BYTES, (ends - begin[row]) * BYTES
            cuts = zip(row.tolist(), froms.tolist(), tos.tolist())
            data = pa.array([bodies[r][a:b] for r, a, b in cuts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(where // shard),
                    pa.array(where),
                    pa.array(starts - numbers * length),
                    pa.array(numbers),
                    data,
                ],
                ["shard", "slot", "at", "sequence", "data"],
            )

    kind = "shard bigint, slot bigint, at bigint, sequence bigint, data binary"
    return rows.select("offset", "tokens").mapInArrow(cut, kind)


# One row, that is one shard, is one row group.
ROW_GROUPS = {"parquet.block.row.count.limit": "1"}
SHARD = "shard bigint, first_slot bigint, last_slot bigint, sequences array<bigint>, data binary"


def ranges(sequences: int, shard: int, tasks: int) -> tuple[int, int]:
    """(number of ranges, shards in each): one range a task, until ranges are full."""
    total = max(1, -(-sequences // shard))
    each = min(RANGE_SHARDS, -(-total // tasks))
    return -(-total // each), each


def shards(parts: DataFrame, length: int, count: int, each: int) -> DataFrame:
    """One row per shard: its sequence numbers by slot and its block of bytes.

    Partition i holds the ``each`` shards from i * each on, sorted by slot, and only one shard
    is held at a time; its size is fixed. The last sequence is filled up with end tokens.
    """
    stride = length * BYTES
    fill = np.full(length, END, "<u2").tobytes()

    def block(shard: int, slots_: list, numbers: list, body: list) -> pa.RecordBatch:
        data = b"".join(body)
        data += fill[: -len(data) % stride]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int64()),
                pa.array([slots_[0]], pa.int64()),
                pa.array([slots_[-1]], pa.int64()),
                pa.array([numbers], pa.list_(pa.int64())),
                pa.array([data], pa.binary()),
            ],
            ["shard", "first_slot", "last_slot", "sequences", "data"],
        )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, slots_, numbers, body, filled = None, [], [], [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "slot", "sequence", "data")]
            for shard, slot, number, data in zip(*columns):
                if shard != now and body:
                    yield block(now, slots_, numbers, body)
                    slots_, numbers, body, filled = [], [], [], 0
                now = shard
                if not slots_ or slots_[-1] != slot:
                    # The one sequence that is not full may lie anywhere.
                    if filled % stride:
                        body.append(fill[: -filled % stride])
                    slots_.append(slot)
                    numbers.append(number)
                    filled = 0
                body.append(data)
                filled += len(data)
        if body:
            yield block(now, slots_, numbers, body)

    dealt = parts.repartitionById(count, F.floor(F.col("shard") / each).cast("int"))
    return dealt.sortWithinPartitions("shard", "slot", "at").mapInArrow(gather, SHARD)


def materialise(
    docs: DataFrame,
    path: str,
    ident: str = "doc_id",
    text: str = "text",
    key: int = 1,
    length: int = LENGTH,
    shard_size: int = SHARD_SEQUENCES,
    ranks_path: str = RANKS,
) -> DataFrame:
    """Write the shards of ``docs`` to ``path`` and return the written table.

    Order of the stream: by id, null ids first, equal ids by their tokens. Null and empty
    texts are a single end token. Repeated rows each have a place of their own. An empty
    table writes an empty table. Other columns are not looked at.
    """
    rows = tokenised(docs, ident, text, read_ranks(ranks_path))
    total = rows.agg(F.sum("n")).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count, each = ranges(-(-total // length), shard_size, tasks)
    found = shards(pieces(with_offsets(rows), total, length, key, shard_size), length, count, each)
    until = (F.floor(F.col("shard") / each).cast("long") + 1) * F.lit(each * shard_size)
    return stage(found.withColumn("until", until), "shards", path, "until", ROW_GROUPS)


def read_slots(written: DataFrame, length: int = LENGTH, first: int = 0) -> DataFrame:
    """(slot, shard, byte, sequence, tokens) of a written table, from slot ``first`` on.

    A training run resumes so: folders of ranges that end before ``first`` are not opened,
    and row groups of earlier shards in the first folder are not read.
    """
    stride = length * BYTES
    open_ = written.filter((F.col("until") > F.lit(first)) & (F.col("last_slot") >= F.lit(first)))
    rows = open_.select("shard", "first_slot", "data", F.posexplode("sequences").alias("i", "sequence"))
    slot = F.col("first_slot") + F.col("i")
    return rows.select(
        slot.alias("slot"),
        "shard",
        (F.col("i") * stride).cast("long").alias("byte"),
        "sequence",
        F.substring("data", F.col("i") * stride + 1, F.lit(stride)).alias("tokens"),
    ).filter(F.col("slot") >= first)


def training_order(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """One row per slot: shard, byte offset, sequence number, SHA-256 of its token bytes."""
    path = path or scratch_path(docs.sparkSession, "shards")
    written = materialise(docs, path, **options)
    rows = read_slots(written, options.get("length", LENGTH))
    return rows.select(
        "slot", "shard", "byte", "sequence", F.sha2("tokens", 256).alias("sha256")
    )

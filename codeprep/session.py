"""Spark settings for large runs."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import SparkSession

# Shuffled bytes one task should handle, so that sorts and lists fit in its memory.
BYTES_PER_TASK = 128 << 20


def recommended_settings(shuffled_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a job that shuffles about ``shuffled_bytes`` on ``cores`` cores.

    Adaptive execution merges partitions that turn out small but never adds any, so the
    starting number follows the data. Where the narrow side of a join is small in every
    partition it may be hashed, which spares sorting the side with the texts.
    """
    partitions = max(-(-shuffled_bytes // BYTES_PER_TASK), cores)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(BYTES_PER_TASK),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
        "spark.sql.session.timeZone": "UTC",
    }


@contextlib.contextmanager
def applied(spark: SparkSession, shuffled_bytes: int | None) -> Iterator[None]:
    """The recommended settings for the time of a job; none when the size is not given."""
    if shuffled_bytes is None:
        yield
        return
    wanted = recommended_settings(shuffled_bytes, spark.sparkContext.defaultParallelism)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)

"""Looking values up in a constant table that travels with the tasks."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


def constant_lookup(entries: Mapping[str, str | int], kind: str) -> Callable[[Column], Column]:
    """A function from a text column to its value (of SQL type ``kind``), null where absent.

    The table becomes a constant: a list of maps with about one entry each, reached by the
    key's hash. (A single map would be searched entry by entry.) Give tables of a size that
    is known to be bounded; others are joined.
    """
    count = 1 << max(len(entries) - 1, 0).bit_length()
    maps: list[dict[str, str | int]] = [{} for _ in range(count)]
    for key, value in entries.items():
        maps[_bucket(key, count)][key] = value
    table = F.from_json(F.lit(json.dumps(maps)), f"array<map<string,{kind}>>")

    def find(key: Column) -> Column:
        at = F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
        return F.try_element_at(F.get(table, at), key)

    return find


def _bucket(key: str, count: int) -> int:
    """What Spark's ``xxhash64`` gives for a text, modulo ``count`` (a power of two)."""
    return xxhash.xxh64_intdigest(key.encode(), seed=42) % count

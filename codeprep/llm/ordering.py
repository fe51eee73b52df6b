"""Order over all rows without sorting them in one task: buckets that follow an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COARSE = 64


def order_buckets(docs: DataFrame, ident: str, rows_per_bucket: int) -> tuple[Column, Column]:
    """(coarse, bucket) of an integer id: numbers that never fall as the id rises.

    Coarse ranges are cut at quantiles of all ids, and evenly inside, so that a bucket
    holds about ``rows_per_bucket`` rows; the cuts steer how even buckets are and nothing
    else. Null ids lie in bucket 0. Only the ``COARSE`` cuts reach the driver.
    """
    steps = ", ".join(str(i / COARSE) for i in range(1, COARSE))
    seen = docs.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(ident).alias("low"),
        F.max(ident).alias("high"),
        F.expr(f"percentile_approx(`{ident}`, array({steps}), 2000)").alias("cuts"),
    ).first()
    low = seen["low"] if seen["low"] is not None else 0
    high = seen["high"] if seen["high"] is not None else 0
    edges = [low, *[c for c in sorted(set(seen["cuts"] or [])) if low < c], high + 1]
    fine = max(1, -(-seen["n"] // (rows_per_bucket * (len(edges) - 1))))
    limits = F.array(*[F.lit(str(e)).cast("decimal(20,0)") for e in edges])
    at = F.coalesce(F.col(ident), F.lit(low)).cast("decimal(20,0)")
    coarse = F.size(F.filter(F.slice(limits, 1, len(edges) - 1), lambda e: e <= at)) - 1
    begin, end = F.get(limits, coarse), F.get(limits, coarse + 1)
    part = (at - begin).cast("double") / (end - begin).cast("double")
    inside = F.least(F.floor(part * fine), F.lit(fine - 1))
    return coarse, coarse.cast("long") * F.lit(fine) + inside

"""Time the headline queries and print one JSON line.

Reads ``$BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) on ``local[$BENCH_CPUS]``. Each
query runs once to warm up, then ``$BENCH_RUNS`` times (default 3); the median counts. With
``--duckdb`` the same queries' SQL is timed in DuckDB on the same files.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from codeprep.session import recommended_settings  # noqa: E402
from registry.oracles import ORACLES  # noqa: E402
from registry.queries import QUERIES  # noqa: E402

HEADLINE = [
    "processed_fact",
    "fact_row_id",
    "patient_cohort",
    "diagnoses_grouped",
    "notes_codes_by_admission",
    "split_sequential",
    "split_shuffled",
    "example_ids",
    "prompt_pairs",
    "clean_text",
    "vocabulary_topk",
    "causal_tokens",
    "cleaned_tokens",
    "extract_codes",
    "describe_codes",
    "batch_predict_stub",
    "document_pages_concat",
]
TABLES = "customer part orders lineitem documents conversations".split()


def median_seconds(run, runs: int) -> float:
    run()
    taken = []
    for _ in range(runs):
        begun = time.perf_counter()
        run()
        taken.append(time.perf_counter() - begun)
    return round(statistics.median(taken), 3)


def time_duckdb(folder: str, cpus: int, runs: int) -> dict[str, float]:
    import duckdb

    duck = duckdb.connect(config={"threads": cpus})
    for name in TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return {
        name: median_seconds(lambda: duck.execute(ORACLES[name]).to_arrow_table(), runs)
        for name in HEADLINE
    }


def time_spark(folder: str, cpus: int, runs: int) -> dict[str, float]:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("codeprep-bench")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    size = sum(os.path.getsize(f"{folder}/{t}.parquet") for t in TABLES)
    for key, value in recommended_settings(4 * size, cpus).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> None:
        # The no-op sink computes every row and column without moving them to the driver.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

    taken = {name: median_seconds(lambda: run(name), runs) for name in HEADLINE}
    spark.stop()
    return taken


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    timer = time_duckdb if "--duckdb" in sys.argv else time_spark
    taken = timer(folder, cpus, runs)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(taken.values()), 3),
                "unit": "sec",
                "queries": taken,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

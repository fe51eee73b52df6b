import pytest
from pyspark.sql import functions as F

from codeprep.operators import numbering as N
from codeprep.staging import placed


@pytest.fixture
def skewed(spark):
    """A third of the rows share one leading key."""
    return spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("long").alias("k"),
        (F.col("id") * 7919 % 3_001).alias("u"),
    )


def expected(df, keys):
    ordered = sorted(tuple(r) for r in df.select(*keys).collect())
    return {key: i + 1 for i, key in enumerate(ordered)}


@pytest.mark.parametrize("parts", [1, 5])
@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_sorted_numbers_equal_a_global_sort(spark, skewed, parts, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = N.number_sorted(skewed.repartition(parts), ["k", "u"], "n", total="rows")
        found = {(r["k"], r["u"]): r["n"] for r in numbered.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found == expected(skewed, ["k", "u"])
    assert {r["rows"] for r in numbered.select("rows").collect()} == {3_000}


def test_a_hot_leading_key_is_cut(spark, skewed):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = skewed.repartitionByRange("k", "u")
        sizes = ranged.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in sizes) <= 600


def test_string_keys(spark):
    df = spark.range(500).select(F.concat(F.lit("é-"), F.col("id").cast("string")).alias("s"))
    found = {r["s"]: r["n"] for r in N.number_sorted(df, ["s"], "n").collect()}
    assert found == {s: i for (s,), i in expected(df, ["s"]).items()}


def test_many_files_are_taken_in_the_order_of_their_tasks(spark):
    names = [f"d/part-{i:05d}-x.parquet" for i in (3, 99_999, 100_000, 7)]
    df = spark.createDataFrame([(f, r) for f in names for r in (0, 1)], "_file string, _row long")
    kept = df.withColumn("name", F.col("_file")).withColumn("at", F.col("_row"))
    found = {(r["name"], r["at"]): r["n"] for r in N.number_placed(kept, "n").collect()}
    order = [names[0], names[3], names[1], names[2]]
    assert [found[(f, r)] for f in order for r in (0, 1)] == list(range(1, 9))


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "a long")
    assert N.number_sorted(none, ["a"], "n").count() == 0
    one = spark.createDataFrame([(5,)], "a long")
    assert N.number_sorted(one, ["a"], "n", start=0).collect()[0]["n"] == 0


def test_within_groups(spark):
    df = spark.range(1, 101).select(
        F.col("id").alias("row_id"), F.when(F.col("id") <= 80, "train").otherwise("val").alias("s")
    )
    out = N.number_within(df.filter("row_id % 10 <> 0"), ["row_id"], "i", ["s"], start=0)
    for name, size in (("train", 72), ("val", 18)):
        got = [r["i"] for r in out.filter(F.col("s") == name).orderBy("row_id").collect()]
        assert got == list(range(size))


def test_shuffled_is_a_permutation_and_repeats(spark):
    df = spark.range(1, 1_001).withColumnRenamed("id", "row_id")
    a = {r["row_id"]: r["n"] for r in N.number_shuffled(df, "row_id", 42, "n").collect()}
    again = N.number_shuffled(df.repartition(7), "row_id", 42, "n").collect()
    b = {r["row_id"]: r["n"] for r in again}
    other = {r["row_id"]: r["n"] for r in N.number_shuffled(df, "row_id", 43, "n").collect()}
    assert sorted(a.values()) == list(range(1, 1_001))
    assert a == b and a != other


def test_rows_never_meet_in_one_partition(skewed, plan):
    """Only the table of file sizes is brought together."""
    text = plan(N.number_sorted(skewed, ["k", "u"], "n"))
    for part in text.split("Exchange SinglePartition")[1:]:
        assert "_size" in part.split("Exchange hashpartitioning")[0]


def test_file_order_key(spark, tmp_path, plan):
    path = str(tmp_path / "t")
    spark.range(1_000).repartition(7).write.parquet(path)
    there = placed(spark.read.parquet(path), N.FILE, N.ROW)
    place = {r["id"]: (r[N.FILE], r[N.ROW]) for r in there.collect()}
    keyed = N.number_placed(there, "NOTE_PK")
    got = {r["id"]: r["NOTE_PK"] for r in keyed.collect()}
    assert got == {i: n + 1 for n, i in enumerate(sorted(place, key=place.get))}
    assert keyed.columns == ["id", "NOTE_PK"]

from pathlib import Path

from pyspark.sql import functions as F

from codeprep.sources.predictions import save_results


def written(path):
    return sum(f.stat().st_size for f in Path(path).glob("part-*"))


def test_compressed_records_are_the_same_in_fewer_bytes(spark, tmp_path):
    record = F.struct(F.lit("c").alias("code"), F.lit("a description").alias("description"))
    df = spark.range(500).select("id", F.array_repeat(record, 40).alias("predictions"))
    plain, packed = str(tmp_path / "plain"), str(tmp_path / "packed")
    save_results(df, plain)
    save_results(df, packed, "gzip")
    assert list(Path(plain).glob("*.json")) and list(Path(packed).glob("*.json.gz"))
    assert written(packed) * 10 < written(plain)
    read = spark.read.schema(df.schema).json(packed)
    assert sorted(read.collect()) == sorted(df.collect())

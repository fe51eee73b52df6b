"""Path checks on whatever file system the path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return hadoop.getFileSystem(conf).exists(hadoop)


def require(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} not found")
    return path


def under(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"

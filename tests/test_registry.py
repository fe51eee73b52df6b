"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from registry.oracles import ORACLES
from registry.queries import QUERIES, clinical_tables, written_notes

FOLDER = "/root/testdata/sf0.001"
TABLES = "customer part orders lineitem documents conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = registered.entry(spark)
    assert df.columns[0] == "row_id" and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    mine = sorted((repr(tuple(r)) for r in df.select(*columns).collect()))
    assert mine == sorted(repr(tuple(r)) for r in result.fetchall())
    assert mine


def test_notes_without_keys_come_in_many_files(spark, duck):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "false")
        notes = written_notes(clinical_tables(spark, FOLDER))
        assert notes.select(F.spark_partition_id()).distinct().count() > 1
        test_query_equals_sql(spark, duck, "prepared_without_note_keys")
    finally:
        spark.conf.set(setting, before)

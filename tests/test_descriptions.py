import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeprep.config import NO_DESCRIPTION
from codeprep.operators import descriptions, envelopes
from codeprep.operators.descriptions import describe_codes

KIND = "id int, other string, codes array<string>"


def dealt_records(node):
    """Records written by the shuffles of a plan that has run."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return dealt_records(node.executedPlan())
    if name.endswith("QueryStage"):
        return dealt_records(node.plan())
    own = node.metrics().get("shuffleRecordsWritten")
    below = node.children()
    return (own.get().value() if own.isDefined() else 0) + sum(
        dealt_records(below.apply(i)) for i in range(below.size())
    )


def test_many_rows_for_a_code_are_not_dealt_once_for_each_place(spark):
    df = spark.range(600).select("id", F.array(F.lit("a"), F.lit("b"), F.lit("x")).alias("codes"))
    known = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("code"),
        F.md5(F.col("id").cast("string")).alias("description"),
    )
    told = describe_codes(df, ["id"], known).select(F.size("predictions").alias("n"))
    assert [r["n"] for r in told.collect()] == [401] * 600
    assert dealt_records(told._jdf.queryExecution().executedPlan()) < 10_000


def test_envelopes_deal_no_record_either(spark):
    df = spark.range(300).select("id", F.array(F.lit("a"), F.lit("a")).alias("codes"))
    known = spark.range(200).select(F.lit("a").alias("code"), F.col("id").cast("string").alias("description"))
    told = describe_codes(df, ["id"], known).withColumns(
        {"processing_time": F.lit(0.0), "model_version": F.lit("v")}
    )
    reply = envelopes.response_envelope(told, ["id"], "now", "id")
    sizes = reply.select("request_id", F.size("predictions").alias("n"))
    found = sizes.collect()
    assert {r["n"] for r in found} == {400} and len({r["request_id"] for r in found}) == 300
    assert dealt_records(sizes._jdf.queryExecution().executedPlan()) < 5_000


@pytest.mark.parametrize("entries, least", [(1 << 21, 8_192), (3, 1), (7, 2)])
def test_blocks_change_no_row(spark, monkeypatch, entries, least):
    monkeypatch.setattr(descriptions, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(descriptions, "LEAST_ROWS", least)
    rows = [
        (1, "m", ["b", "a", "b", "zz"]),
        (1, "m", ["b", "a", "b", "zz"]),
        (2, None, []),
        (3, "o", None),
        (None, "p", ["a", None, "ü", "a"]),
        (5, "q", [None]),
        *[(i, "r", ["b"] * (i % 5)) for i in range(10, 40)],
    ]
    known = [("a", "A!"), ("b", "B2"), ("b", "B1"), ("b", "B1"), ("ü", None), ("ü", "Größe"),
             (None, "none"), ("", "empty")]

    def expected(codes):
        found = lambda c: sorted(d or NO_DESCRIPTION for k, d in known if c is not None and k == c)
        return [(c, d) for c in codes or [] for d in found(c) or [NO_DESCRIPTION]]

    got = describe_codes(
        spark.createDataFrame(rows, KIND).repartition(3),
        ["id"],
        spark.createDataFrame(known, "code string, description string"),
    )
    assert got.columns == ["id", "other", "codes", "predictions"]
    mine = [(i, o, c, [tuple(p) for p in told]) for i, o, c, told in got.collect()]
    assert sorted(mine, key=repr) == sorted(
        [(i, o, c, expected(c)) for i, o, c in rows], key=repr
    )


def test_no_rows_and_no_dictionary(spark):
    none = spark.createDataFrame([], "code string, description string")
    assert describe_codes(spark.createDataFrame([], KIND), ["id"], none).collect() == []
    got = describe_codes(spark.createDataFrame([(1, "m", ["b"])], KIND), ["id"], none).collect()
    assert [tuple(p) for p in got[0]["predictions"]] == [("b", NO_DESCRIPTION)]


@pytest.mark.parametrize("size", [1, 90, 8 << 20])
def test_records_come_in_bounded_batches(monkeypatch, size):
    monkeypatch.setattr(descriptions, "RECORD_BYTES", size)
    values = pa.RecordBatch.from_pydict(
        {"_code": ["a", "b"], "_text": ["A1A22ö", "B"], "_sizes": [[2, 3, 2], [1]]},
        pa.schema([("_code", pa.string()), ("_text", pa.string()), ("_sizes", pa.list_(pa.int32()))]),
    )
    lists = [["x"], ["b", "a"], None, [], ["a", None], ["b"]]
    rows = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], ["codes"]).slice(1)
    found = [*descriptions._described(rows, "codes", "told", *descriptions._descriptions([values], pa.string()))]
    assert (len(found) == 1) == (size > 1_000)
    told = [[tuple(p.values()) for p in r["told"]] for b in found for r in b.to_pylist()]
    three = [("a", "A1"), ("a", "A22"), ("a", "ö")]
    assert told == [[("b", "B"), *three], [], [], [*three, (None, NO_DESCRIPTION)], [("b", "B")]]

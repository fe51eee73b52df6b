import pytest
from pyspark.sql import functions as F

from codeprep.functions import codes as C


def one(spark, value, kind, fn):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(fn(F.col("x"))).collect()[0][0]


def test_extract_and_parse(spark):
    text = " ICD-10:I10 ,\n E11.9,, plain,\t8-9  , "
    assert one(spark, text, "string", C.extract_codes) == ["ICD-10:I10", "E11.9", "plain", "8-9"]
    assert one(spark, text, "string", C.parse_codes) == ["ICD-10:I10", "8-9"]
    assert one(spark, "", "string", C.extract_codes) == []


def test_cap(spark):
    codes = ["a", "b", "c"]
    assert one(spark, codes, "array<string>", lambda c: C.cap_codes(c, 2)) == ["a", "b"]
    assert one(spark, codes, "array<string>", lambda c: C.cap_codes(c, 0)) == []
    assert one(spark, codes, "array<string>", C.cap_codes) == codes
    with pytest.raises(ValueError):
        C.cap_codes(F.col("x"), -1)


def test_lists(spark):
    df = spark.createDataFrame(
        [(["a"], None), (None, ["b"]), (None, None), (["a"], [])],
        "d array<string>, p array<string>",
    )
    both = C.all_codes(F.col("d"), F.col("p"))
    got = df.select(both, C.joined(both), C.with_system(both, "ICD-9")).collect()
    assert [tuple(r) for r in got] == [
        (["a"], "a", ["ICD-9:a"]),
        (["b"], "b", ["ICD-9:b"]),
        ([], "", []),
        (["a"], "a", ["ICD-9:a"]),
    ]


def test_descriptions(spark):
    known = {"SYS-1:Q7": "an invented illness"}
    got = one(spark, ["SYS-1:Q7", "X-1"], "array<string>", lambda c: C.described(c, known))
    assert [tuple(r) for r in got] == [
        ("SYS-1:Q7", "an invented illness"),
        ("X-1", "Description not available"),
    ]
    none = one(spark, ["X-1"], "array<string>", lambda c: C.described(c, {}))
    assert [tuple(r) for r in none] == [("X-1", "Description not available")]
    bare = one(spark, ["X-1"], "array<string>", C.undescribed)
    assert [tuple(r) for r in bare] == [("X-1", None)]
    long = {f"é{i}": f"d{i}" for i in range(3_000)}
    codes = ["é0", "é2999", "é3000", None]
    got = one(spark, codes, "array<string>", lambda c: C.described(c, long))
    assert [r[1] for r in got] == ["d0", "d2999", *["Description not available"] * 2]

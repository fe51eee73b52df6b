from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from codeprep import staging
from codeprep.operators import tokens as K
from codeprep.operators import vocabulary as V

TEXTS = ["a b a c", "the, the; the é", "", None, "b" * 5 + " unknownword 7" * 40]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def words(text):
    return regex.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]", text or "")


def ranked(size):
    counts = Counter(w for t in TEXTS for w in words(t))
    top = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:size]
    return {w: i + 2 for i, (w, _) in enumerate(top)}


@pytest.mark.parametrize("size", [1, 4, 100])
def test_vocabulary(texts, size):
    table = V.build_vocabulary(texts, F.col("text"), size).table
    assert {r["token"]: r["token_id"] for r in table.collect()} == ranked(size)


@pytest.mark.parametrize("length", [4, 64, None])
@pytest.mark.parametrize("inline", [True, False])
def test_ids_by_both_ways(texts, monkeypatch, length, inline):
    vocabulary = V.build_vocabulary(texts, F.col("text"), 4)
    if not inline:
        monkeypatch.setattr(V, "INLINE_TOKENS", 0)
    # Null texts, a key that is missing, and rows with equal keys.
    more = texts.unionByName(texts.filter("id < 2")).unionByName(
        texts.select(F.lit(None).cast("int").alias("id"), "text")
    )
    got = K.token_ids(more, ["id"], F.col("text"), vocabulary, length).collect()
    known = ranked(4)
    ids = [[known.get(w, 1) for w in words(t)][:length] for t in TEXTS]
    wanted = [*enumerate(ids), (0, ids[0]), (1, ids[1]), *[(None, i) for i in ids]]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))


def test_causal_records_are_the_same_both_ways(texts, monkeypatch, rows):
    vocabulary = V.build_vocabulary(texts, F.col("text"), 4)
    inline = rows(K.causal_tokens(texts, ["id"], vocabulary, 8))
    monkeypatch.setattr(V, "INLINE_TOKENS", 0)
    assert rows(K.causal_tokens(texts, ["id"], vocabulary, 8)) == inline
    assert (3, [0] * 8, [0] * 8, [0] * 8) in inline  # the null text


def test_causal_records(texts):
    vocabulary = V.build_vocabulary(texts, F.col("text"), 4)
    for r in K.causal_tokens(texts.fillna(""), ["id"], vocabulary, 8).collect():
        n = min(len(words(TEXTS[r["id"]])), 8)
        assert len(r["input_ids"]) == len(r["attention_mask"]) == 8
        assert r["attention_mask"] == [1] * n + [0] * (8 - n)
        assert all(i == 0 for i in r["input_ids"][n:]) and r["labels"] == r["input_ids"]


def test_cleaned_flags(spark):
    df = spark.createDataFrame([(1, " x \n\n y  z ")], "id int, text string")
    vocabulary = V.build_vocabulary(df, F.col("text"), 10)

    def ids(**flags):
        return K.cleaned_tokens(df, ["id"], vocabulary, 2, **flags).collect()[0]["input_ids"]

    assert ids() == [2, 3]
    assert ids(truncation=False) == [2, 3, 4]
    assert ids(padding=False, truncation=False) == [2, 3, 4]
    long = K.cleaned_tokens(df, ["id"], vocabulary, 5).collect()[0]
    assert long["input_ids"] == [2, 3, 4, 0, 0] and long["attention_mask"] == [1, 1, 1, 0, 0]


def test_json_round_trip(texts, rows):
    vocabulary = V.build_vocabulary(texts, F.col("text"), 4)
    ids = K.causal_tokens(texts.fillna(""), ["id"], vocabulary, 8)
    text = K.tokens_to_json(ids)
    assert dict(text.dtypes)["input_ids"] == "string"
    assert rows(K.tokens_from_json(text)) == rows(ids)


def test_lookup_needs_no_shuffle(texts, plan):
    vocabulary = V.build_vocabulary(texts, F.col("text"), 4)
    text = plan(K.causal_tokens(texts, ["id"], vocabulary, 8))
    assert "hashpartitioning" not in text and "Join" not in text


def test_top_k_is_not_gathered(texts, plan):
    for size in (2, 50):
        text = plan(V.build_vocabulary(texts, F.col("text"), size).table)
        assert "TakeOrdered" not in text


def test_cutoff(spark):
    counts = spark.createDataFrame([(f"t{i}", 1 + i // 3) for i in range(9)], "token string, n long")
    assert [V.cutoff(counts, k) for k in (1, 3, 4, 9, 10)] == [3, 3, 2, 1, None]


def test_tokens_lie_in_several_tasks(spark):
    texts = spark.range(64).select("id", F.lit("a b c").alias("text")).coalesce(1)
    vocabulary = V.build_vocabulary(texts, F.col("text"), 4)
    ids = K.causal_tokens(texts, ["id"], vocabulary, 8)
    assert ids.select(F.spark_partition_id()).distinct().count() > 1


def test_oversized_table_is_refused(texts):
    whole = V.build_vocabulary(texts, F.col("text"), 100).table
    with pytest.raises(ValueError):
        V.Vocabulary(whole, 2).ids_of(F.col("text"))


def test_spread_runs_no_plan(spark):
    """A joined table is left as it is, and no job is started to look at it."""
    left = spark.range(50).select("id", F.lit("a b").alias("text"))
    joined = left.join(spark.range(50).hint("merge"), "id").groupBy("id").agg(F.max("text").alias("text"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("spread", "")
    try:
        assert staging.spread(joined, "id") is joined
        assert not tracker.getJobIdsForGroup("spread")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rows_keep_their_place_when_tasks_run_again(spark, rows):
    """Rows with equal keys stay apart, by a place that does not depend on the task."""
    texts = spark.createDataFrame([(1, "a b"), (1, "b"), (1, "a b")] * 20, "id int, text string").repartition(5)
    vocabulary = V.build_vocabulary(texts, F.col("text"), 4)
    ids = K._joined_ids(texts.select("id", F.split("text", " ").alias("_words")), ["id"], vocabulary)
    plan = ids._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically" not in plan and ids.count() == 60

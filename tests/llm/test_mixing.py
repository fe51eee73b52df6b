import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeprep.llm import mixing as M


def fitted(cells, targets, rounds=200):
    """Raking with arrays: cells {(a, b): total}, targets [{a: share}, {b: share}]."""
    now = dict(cells)
    for _ in range(rounds):
        for axis, goal in enumerate(targets):
            sums = {}
            for k, v in now.items():
                sums[k[axis]] = sums.get(k[axis], 0) + v
            now = {
                k: v * goal.get(k[axis], 0) / sums[k[axis]] if sums[k[axis]] else 0
                for k, v in now.items()
            }
    return now


CELLS = {("x", "p"): 50.0, ("x", None): 10.0, ("y", "p"): 5.0, ("y", None): 80.0, (None, "p"): 7.0}


def test_rake_equals_arrays(spark):
    cells = spark.createDataFrame([(*k, 1, v) for k, v in CELLS.items()], "a string, b string, n_docs long, total double")
    goals = [{"x": 0.5, "y": 0.4, None: 0.1}, {"p": 0.55, None: 0.45}]
    tables = {
        c: spark.createDataFrame(list(g.items()), f"{c} string, target double")
        for c, g in zip("ab", goals)
    }
    got = {(r["a"], r["b"]): r["fitted"] for r in M.rake(cells, tables).collect()}
    wanted = fitted(CELLS, goals)
    assert all(abs(got[k] - wanted[k]) < 1e-4 for k in CELLS)
    for axis, goal in enumerate(goals):
        for name, share in goal.items():
            assert abs(sum(v for k, v in got.items() if k[axis] == name) - share) < 1e-5


def test_category_without_a_target_gets_nothing(spark):
    cells = spark.createDataFrame([("x", 1, 5.0), ("y", 1, 5.0)], "a string, n_docs long, total double")
    target = spark.createDataFrame([("x", 1.0)], "a string, target double")
    got = {r["a"]: r["fitted"] for r in M.rake(cells, {"a": target}).collect()}
    assert got == {"x": pytest.approx(1.0), "y": 0.0}


@pytest.fixture(scope="module")
def corpus(spark):
    """A third of the rows from one source."""
    return spark.range(30_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
        F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 5 < 4, "en").otherwise("de").alias("lang"),
        (F.col("id") % 90 + 1).alias("n_tokens"),
    )


def test_sample_meets_the_targets(corpus):
    marginals = ["source", "lang"]
    found = M.mixed(corpus, marginals, "n_tokens", "doc_id", power=0.5, keep=0.5).toPandas()
    assert len(found) == 30_000 and found.probability.between(0, 1).all()
    expected = (found.probability * found.n_tokens).sum() / found.n_tokens.sum()
    assert abs(expected - 0.5) < 1e-6
    taken = found[found.selected]
    for column in marginals:
        whole = found.groupby(column, dropna=False).n_tokens.sum() ** 0.5
        goal = whole / whole.sum()
        drawn = taken.groupby(column, dropna=False).n_tokens.sum() / taken.n_tokens.sum()
        assert np.abs(drawn - goal).max() < 0.03
    again = M.mixed(corpus.repartition(9), marginals, "n_tokens", "doc_id", power=0.5, keep=0.5)
    assert set(again.filter("selected").toPandas().doc_id) == set(taken.doc_id)


def test_copies_meet_the_targets_of_small_categories(spark):
    """At the registered parameters, where rates of small cells pass 1."""
    docs = spark.range(40_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 50 == 0, "rare").otherwise("common").alias("source"),
        F.when(F.col("id") % 7 == 0, "de").when(F.col("id") % 97 == 1, None).otherwise("en").alias("lang"),
        (F.col("id") % 90 + 1).alias("n_tokens"),
    )
    found = M.mixed(docs, ["source", "lang"], "n_tokens", "doc_id").toPandas()
    assert (found.expected_copies > 1).any()
    expected, drawn = found.expected_copies * found.n_tokens, found.n_copies * found.n_tokens
    total = found.n_tokens.sum()
    assert abs(expected.sum() / total - 0.8) < 1e-4 and abs(drawn.sum() / total - 0.8) < 0.02
    assert (abs(found.n_copies - found.expected_copies) < 1).all()
    for column in ("source", "lang"):
        whole = found.groupby(column, dropna=False).n_tokens.sum() ** 0.7
        goal = whole / whole.sum()
        for tokens, gap in ((expected, 1e-4), (drawn, 0.01)):
            share = tokens.groupby(found[column], dropna=False).sum() / tokens.sum()
            assert np.abs(share - goal).max() < gap


def test_pipeline_repeats_documents(spark):
    docs = spark.range(2_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 100 == 0, "rare").otherwise("common").alias("source"),
        F.lit("en").alias("lang"),
        F.lit("plain words here").alias("text"),
    )
    taken = corpus_pipeline.mixing_weights(spark, docs, "")
    assert taken.columns == docs.columns
    tokens = taken.groupBy("source").count().toPandas().set_index("source")["count"]
    goal = 20**0.7 / (20**0.7 + 1_980**0.7)
    assert abs(tokens["rare"] / tokens.sum() - goal) < 0.02


def test_odd_rows(odd_docs, no_docs):
    def drawn(docs):
        docs = docs.withColumn("w", M.token_weight(F.col("text")))
        docs = docs.withColumn("topic", M.topic(F.col("text")))
        return M.mixed(docs, ["source", "lang", "topic"], "w", "doc_id")

    rows = drawn(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    twins = [r["selected"] for r in rows if r["doc_id"] == 16]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert drawn(no_docs).count() == 0


def test_topics_and_weights(spark):
    texts = ["", None, "mail a@b.c", "x ### y", "a | b", "in 1999", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = docs.select(M.topic(F.col("text")), M.token_weight(F.col("text"))).collect()
    assert [r[0] for r in got] == ["empty", "empty", "contact", "markup", "table", "numbers", "prose"]
    assert [r[1] for r in got] == [0, 0, 2, 3, 3, 2, 1]


def test_native_plan(corpus, plan):
    text = plan(M.mixed(corpus, ["source", "lang"], "n_tokens", "doc_id"))
    assert "Python" not in text and "Arrow" not in text

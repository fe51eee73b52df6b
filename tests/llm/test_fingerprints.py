import hashlib

import pytest
from pyspark.sql import functions as F

from codeprep.llm import fingerprints as M
from codeprep.llm.ordering import order_buckets


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def root_of(text):
    """The Merkle root, built in plain Python."""
    sections = []
    for section in (text or "").split("\n\n"):
        sections.append(sha("".join(sha(p) for p in section.split("\n"))))
    return sha("".join(sections))


def edits(rows):
    """(id, edited text) with the next row by descending id; nulls last, equal ids by text."""
    order = sorted(
        rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode())
    )
    out = []
    for (d, t), (_, other) in zip(order, order[1:] + order[:1]):
        t, other = t or "", other or ""
        half = len(t) // 2
        out.append((d, len(t), t[: len(t) - half] + other[:half], t, other))
    return out


def test_fingerprints_equal_brute_force(odd_docs, all_rows):
    got = M.compare_with_edit(odd_docs).collect()
    mine = sorted((repr(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"],
                   r["edited_fingerprint"]) for r in got)
    assert mine == sorted(
        (repr(d), n, sha(e), root_of(t), root_of(e)) for d, n, e, t, _ in edits(all_rows)
    )
    for r in got:
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        if r["fingerprint"] == r["edited_fingerprint"]:
            assert r["near_edited"] == 1 and r["n_changed"] == 0
        else:
            assert r["n_changed"] > 0
    near = {r["doc_id"]: (r["near_edited"], r["near_next"]) for r in got}
    assert near[10][0] > 0.3 and near[10][0] > near[10][1]


@pytest.mark.parametrize("bucket", [1, 3, 1_000])
def test_next_text_across_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(M, "BUCKET_ROWS", bucket)
    ids = [*range(0, 50, 7), 10**15, 10**15 + 1, -(10**17), 2**63 - 1, -(2**63), None]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    found = M.with_next_text(docs, "doc_id", "text", "after")
    order = sorted((i for i in ids if i is not None), reverse=True) + [None]
    after = dict(zip(order, order[1:] + order[:1]))
    assert {r["doc_id"]: r["after"] for r in found.collect()} == {
        i: f"t{after[i]}" for i in ids
    }


def test_one_document_and_none(spark, no_docs):
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    row = M.compare_with_edit(one).collect()[0]
    assert row["edited_sha256"] == sha("abab") and row["near_next"] == 1
    assert M.compare_with_edit(no_docs).count() == 0


def test_differing_branches(spark):
    texts = [("a\nb\n\nc\nd", "a\nb\n\nc\nX"), ("a\nb", "a\nb\nc"), ("x", "x"), ("", None)]
    docs = spark.createDataFrame(texts, "p string, q string")
    diff = M.differing_paragraphs(M.tree(F.col("p")), M.tree(F.col("q")))
    got = [[tuple(x) for x in r[0]] for r in docs.select(diff).collect()]
    assert got == [[(1, 1)], [(0, 2)], [], []]


def test_tree_column_with_a_taken_name(odd_docs):
    assert M.with_tree(odd_docs, "n").columns[-1] == "n_"


def test_native_plan(odd_docs, plan):
    text = plan(M.compare_with_edit(odd_docs))
    assert "Python" not in text and "Arrow" not in text


def test_buckets_follow_the_order(spark):
    df = spark.range(0, 10_000, 3).select((F.col("id") * F.col("id")).alias("k"))
    coarse, bucket = order_buckets(df, "k", 100)
    rows = df.select("k", coarse.alias("c"), bucket.alias("b")).orderBy("k").collect()
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)
    assert [r["c"] for r in rows] == sorted(r["c"] for r in rows)
    assert len({r["b"] for r in rows}) > 20

import json

import pytest
from pyspark.sql import functions as F

from codeprep.config import EMPTY_DOCUMENT, NO_DESCRIPTION
from codeprep.operators import descriptions, envelopes, scoring
from codeprep.plans import score
from codeprep.sources.documents import read_documents
from codeprep.sources.predictions import save_results


KNOWN = {"SYS-1:Q7": "an invented illness", "SYS-1:Q8": "another one"}


def fake_model():
    """Two invented codes and the size of the batch; fails on one word."""

    def answer(prompts):
        if any("boom" in p for p in prompts):
            raise ValueError("no answer to that")
        return [f"{p}\nSYS-1:Q7, SYS-1:Q8, X-{len(prompts)}" for p in prompts]

    return answer


@pytest.fixture
def documents(spark):
    rows = [
        (1, "slept badly, coughs", ("note.pdf", 1)),
        (2, "boom", ("bad.pdf", 1)),
        (3, "", ("empty.pdf", 2)),
        (4, None, ("missing.pdf", 0)),
        (5, "fine", ("fine.pdf", 1)),
    ]
    kind = "id int, content string, metadata struct<filename:string,page_count:int>"
    return spark.createDataFrame(rows, kind).coalesce(1)


def test_one_bad_text_does_not_stop_the_others(documents):
    got = scoring.batch_predict(documents, fake_model(), "v1.0", "content")
    result = {r["id"]: r for r in got.collect()}
    assert result[1]["codes"][:2] == ["SYS-1:Q7", "SYS-1:Q8"]
    assert result[1]["error"] is None and result[1]["model_version"] == "v1.0"
    assert result[2]["codes"] == [] and result[2]["error"] == "no answer to that"
    for i in (3, 4):
        assert result[i]["codes"] == []
        assert result[i]["error"] == EMPTY_DOCUMENT
    assert result[5]["error"] is None


def test_batches_hold_at_most_batch_size(spark):
    texts = spark.range(10).select("id", F.lit("t").alias("text")).coalesce(1)
    got = scoring.batch_predict(texts, fake_model(), "v", batch_size=4).collect()
    assert sorted(r["codes"][2] for r in got) == ["X-2"] * 2 + ["X-4"] * 8


def test_wrong_number_of_answers_is_an_error(spark):
    def short():
        return lambda prompts: []

    texts = spark.createDataFrame([(1, "t")], "id int, text string")
    assert "0 responses" in scoring.batch_predict(texts, short(), "v").collect()[0]["error"]


def test_empty_documents(documents):
    got = scoring.empty_documents(documents).collect()
    assert {r["pdf_metadata"]["filename"] for r in got} == {"empty.pdf", "missing.pdf"}


def test_documents_to_records(documents, tmp_path):
    told = score.score_documents(
        documents, ["id"], fake_model(), "v1.0", max_codes=2, descriptions=KNOWN
    )
    worked, failed = score.responses(told, ["id"], "2024-01-01T00:00:00", "pdf")
    reply = {r["id"]: r.asDict(recursive=True) for r in worked.collect()}
    assert set(reply) == {1, 5}
    assert reply[1]["predictions"] == [
        {"code": "SYS-1:Q7", "description": "an invented illness"},
        {"code": "SYS-1:Q8", "description": "another one"},
    ]
    assert reply[1]["model_info"] == {"version": "v1.0", "timestamp": "2024-01-01T00:00:00"}
    errors = {r["id"]: r.asDict(recursive=True) for r in failed.collect()}
    assert errors[2]["error"] == {
        "code": "PDF_PROCESSING_ERROR",
        "message": "PDF file could not be processed",
        "details": {
            "reason": "no answer to that",
            "suggestion": "Please ensure the PDF is valid and contains text",
        },
    }
    assert set(errors) == {2, 3, 4}
    assert reply[1]["request_id"] != reply[5]["request_id"]
    path = str(tmp_path / "new" / "results")
    save_results(told, path)
    lines = told.sparkSession.read.text(path).collect()
    assert sorted(json.loads(r[0])["id"] for r in lines) == [1, 2, 3, 4, 5]


def test_score_to_json(documents, tmp_path):
    spark, out = documents.sparkSession, str(tmp_path / "out")
    scored = score.score_to_json(documents, ["id"], fake_model(), "v1.0", out, "now", max_codes=1)
    assert scored.count() == 5
    assert spark.read.json(f"{out}/responses").count() == 2
    reasons = spark.read.json(f"{out}/errors").select("error.details.reason").collect()
    assert sorted(r[0] for r in reasons)[-1] == "no answer to that" and len(reasons) == 3


def test_text_errors(documents):
    failed = scoring.batch_predict(documents, fake_model(), "v1.0", "content")
    reply = envelopes.error_envelope(failed.filter("id = 2"), ["id"], "now").collect()[0]
    assert reply["error"]["code"] == "PREDICTION_ERROR" and reply["timestamp"] == "now"


def test_results_are_printed(spark, capsys):
    save_results(spark.createDataFrame([(1, ["a"])], "id int, codes array<string>"))
    assert json.loads(capsys.readouterr().out) == {"id": 1, "codes": ["a"]}
    save_results(spark.range(1_203))
    assert len(capsys.readouterr().out.split("}")) == 1_204


def test_dictionary_table(spark):
    df = spark.createDataFrame(
        [(1, "m", ["b", "a", "b", "zz"]), (2, "n", []), (3, "o", None)],
        "id int, other string, codes array<string>",
    )
    known = spark.createDataFrame([("a", "A!"), ("b", "B!")], "code string, description string")
    got = {r["id"]: r for r in descriptions.describe_codes(df, ["id"], known).collect()}
    assert [tuple(p) for p in got[1]["predictions"]] == [
        ("b", "B!"),
        ("a", "A!"),
        ("b", "B!"),
        ("zz", NO_DESCRIPTION),
    ]
    assert got[1]["other"] == "m" and got[2]["predictions"] == [] and got[3]["predictions"] == []


def test_equal_keys_and_equal_rows_stay_apart(spark):
    df = spark.createDataFrame(
        [(1, "m", ["b"]), (1, "n", ["a", "b"]), (1, "n", ["a", "b"]), (None, "o", None)],
        "id int, other string, codes array<string>",
    )
    known = spark.createDataFrame([("b", "B!")], "code string, description string")
    got = descriptions.describe_codes(df, ["id"], known).collect()
    sizes = sorted((r["other"], len(r["predictions"])) for r in got)
    assert sizes == [("m", 1), ("n", 2), ("n", 2), ("o", 0)]


def test_rows_without_codes_do_not_meet_in_one_task(spark):
    df = spark.range(4_000).select("id", F.lit(None).cast("array<string>").alias("codes"))
    known = spark.range(10).select(F.col("id").cast("string").alias("code"), F.lit("d").alias("description"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        told = descriptions.describe_codes(df, ["id"], known)
        joined = told._jdf.queryExecution().optimizedPlan().toString()
        assert "coalesce(code" in joined and told.count() == 4_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def reader():
    def pages(blob):
        if blob.startswith(b"torn"):
            raise ValueError("the file is torn")
        return [blob.decode()]

    return pages


def test_files_to_records(spark, tmp_path):
    """The whole way from files; the reason of an unreadable file is kept."""
    for name, body in {"a.pdf": b"slept badly", "b.pdf": b"torn", "c.pdf": b" "[:0] + b"\n"}.items():
        (tmp_path / name).write_bytes(body)
    found = read_documents(spark, str(tmp_path), reader())
    out = str(tmp_path / "out")
    scored = score.score_to_json(found, ["path"], fake_model(), "v1.0", out, "now")
    assert scored.count() == 3 and scored.columns.count("error") == 1
    errors = spark.read.json(f"{out}/errors").collect()
    assert [r["error"]["details"]["reason"] for r in errors] == [
        "Could not process PDF: the file is torn"
    ]
    assert spark.read.json(f"{out}/responses").count() == 2


def test_other_clashing_names_are_refused(spark):
    texts = spark.createDataFrame([("t", "x")], "text string, codes string")
    with pytest.raises(ValueError, match="codes"):
        scoring.batch_predict(texts, fake_model(), "v")


def test_model_runs_once_with_a_dictionary_table(documents, plan):
    known = documents.sparkSession.createDataFrame(
        list(KNOWN.items()), "code string, description string"
    )
    told = score.score_documents(documents, ["id"], fake_model(), "v", descriptions=known)
    text = told._jdf.queryExecution().sparkPlan().toString()
    assert "ArrowEvalPython" not in text  # it has run, once, when its answers were written
    assert {r["id"]: len(r["predictions"]) for r in told.collect()} == {1: 3, 2: 0, 3: 0, 4: 0, 5: 3}

import pytest

from codeprep.config import MIMIC_III, MIMIC_IV
from codeprep.operators import examples as E


def test_records_and_empty_rules(spark):
    fact = spark.createDataFrame(
        [
            (1, "note", ["0389"], ["3893"], 5, 6, "DS"),
            (2, None, ["0389"], [], 5, 7, "DS"),
            (3, "note", [], None, 5, 8, None),
        ],
        "row_id long, TEXT string, diagnosis_codes array<string>, procedure_codes array<string>,"
        " SUBJECT_ID long, HADM_ID long, NOTE_TYPE string",
    )
    records = E.example_records(fact, MIMIC_IV, "row_id").orderBy("row_id").collect()
    assert records[0].asDict(recursive=True) == {
        "row_id": 1,
        "text": "note",
        "codes": ["ICD-10:0389", "ICD-10:3893"],
        "metadata": {"source": "mimic-iv", "hadm_id": 6, "subject_id": 5, "note_type": "DS"},
    }
    assert records[1]["text"] == "" and records[2]["codes"] == []
    kept = E.training_examples(E.example_records(fact, MIMIC_IV, "row_id"))
    assert [r["row_id"] for r in kept.collect()] == [1]


def test_required_fields(spark):
    df = spark.createDataFrame(
        [("", [], ("x",)), (None, ["a"], ("x",)), ("t", None, ("x",)), ("t", ["a"], None)],
        "text string, codes array<string>, metadata struct<source:string>",
    )
    got = E.examples_with_required_fields(df).collect()
    assert sorted((r["text"], r["codes"], r["metadata"]["source"]) for r in got) == [
        ("", [], "x"),
        ("t", ["a"], None),
    ]
    bare = E.examples_with_required_fields(df.drop("metadata"))
    assert bare.count() == 2 and "metadata" in bare.columns


@pytest.mark.parametrize("hot", [False, True])
def test_by_admission(spark, monkeypatch, hot):
    if hot:
        real = E.hot_keys
        monkeypatch.setattr(E, "hot_keys", lambda df, on: real(df, on, rows_per_task=1))
    notes = spark.createDataFrame(
        [
            (1, 5, 6, "Radiology", "a"),
            (2, 5, 0, "Radiology", "b"),
            (3, 5, None, "Radiology", "c"),
            (4, 9, 6, "Nursing", None),
            (5, 5, 7, "Radiology", "no codes"),
        ],
        "NOTE_PK long, SUBJECT_ID long, HADM_ID long, CATEGORY string, TEXT string",
    )
    codes = spark.createDataFrame(
        [(5, 6, 2, "b"), (5, 6, 1, "a"), (5, 0, 1, "z"), (5, 8, 1, "y")],
        "SUBJECT_ID long, HADM_ID long, SEQ_NUM int, ICD9_CODE string",
    )
    got = E.examples_by_admission(notes, codes, MIMIC_III, "NOTE_PK", "NOTE_PK").collect()
    assert sorted((r["NOTE_PK"], r["text"], r["codes"]) for r in got) == [
        (1, "a", ["ICD-9:a", "ICD-9:b"]),
        (4, "", ["ICD-9:a", "ICD-9:b"]),
    ]


def test_pairs(spark):
    df = spark.createDataFrame([("t", ["a", "b"])], "text string, codes array<string>")
    pairs = E.prompt_pairs(df)
    assert tuple(pairs.collect()[0]) == (
        "Predict the medical codes for the following text:\n\nt",
        "a, b",
    )
    assert E.causal_texts(pairs).collect()[0][0].endswith(":\n\nta, b")

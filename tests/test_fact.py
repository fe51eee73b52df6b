import pytest
from pyspark.sql import functions as F

from codeprep.operators import fact as fact_operators
from codeprep.config import MIMIC_III, MIMIC_IV
from codeprep.operators import cohort, fact, grouping, notes
from codeprep.plans import fact as job

DS = MIMIC_III.discharge_kind


@pytest.fixture
def tables(spark):
    return {
        "notes": spark.createDataFrame(
            [
                (1, 10, 100, DS, "first"),
                (2, 10, 100, DS, "second"),
                (3, 10, 101, DS, "no diagnoses"),
                (4, 11, 110, "Radiology", "other kind"),
                (5, 11, 110, DS, "no procedures"),
                (6, None, 120, DS, "no patient"),
                (7, 12, None, DS, "no admission"),
                (8, 13, 130, DS, "only missing codes"),
                (9, 14, 140, DS, None),
            ],
            "NOTE_PK long, SUBJECT_ID long, HADM_ID long, CATEGORY string, TEXT string",
        ),
        "diagnoses": spark.createDataFrame(
            [
                (10, 100, 2, "0389"),
                (10, 100, 1, "25000"),
                (10, 100, 2, "0389"),
                (10, 100, None, "9"),
                (10, 100, 3, None),
                (11, 110, 1, "4019"),
                (12, None, 1, "1"),
                (13, 130, 1, None),
                (14, 140, 1, "7"),
                (15, 150, 1, "8"),
            ],
            "SUBJECT_ID long, HADM_ID long, SEQ_NUM int, ICD9_CODE string",
        ),
        "procedures": spark.createDataFrame(
            [(10, 100, 1, "3893"), (10, 101, 1, "9671"), (14, 140, 1, None)],
            "SUBJECT_ID long, HADM_ID long, SEQ_NUM int, ICD9_CODE string",
        ),
        "patients": spark.createDataFrame([(10, "F"), (14, "M")], "SUBJECT_ID long, GENDER string"),
    }


def test_group_codes(tables, rows):
    got = grouping.group_codes(tables["diagnoses"], MIMIC_III, "c")
    assert rows(got) == sorted(
        [
            (10, 100, ["25000", "0389", "0389", "9"]),
            (11, 110, ["4019"]),
            (12, None, ["1"]),
            (14, 140, ["7"]),
            (15, 150, ["8"]),
        ],
        key=repr,
    )


def test_group_codes_without_sequence_numbers(tables, rows):
    plain = tables["diagnoses"].drop("SEQ_NUM").filter("HADM_ID = 100")
    assert rows(grouping.group_codes(plain, MIMIC_III, "c", ["HADM_ID"])) == [
        (100, ["0389", "0389", "25000", "9"])
    ]


def test_fact(tables):
    got = job.processed_fact(**tables, version="mimic-iii").orderBy("row_id").collect()
    assert [tuple(r) for r in got] == [
        (1, 1, 10, 100, DS, "first", ["25000", "0389", "0389", "9"], ["3893"],
         ["25000", "0389", "0389", "9", "3893"], "25000,0389,0389,9", "3893",
         "25000,0389,0389,9,3893", "F"),
        (2, 2, 10, 100, DS, "second", ["25000", "0389", "0389", "9"], ["3893"],
         ["25000", "0389", "0389", "9", "3893"], "25000,0389,0389,9", "3893",
         "25000,0389,0389,9,3893", "F"),
        (3, 5, 11, 110, DS, "no procedures", ["4019"], [], ["4019"], "4019", "", "4019", None),
        (4, 9, 14, 140, DS, None, ["7"], [], ["7"], "7", "", "7", "M"),
    ]


def test_fact_survives_hot_admissions(tables, rows, monkeypatch):
    plain = rows(job.processed_fact(**tables, version="mimic-iii"))
    real = job.hot_keys
    monkeypatch.setattr(job, "hot_keys", lambda df, on: real(df, on, rows_per_task=1))
    assert rows(job.processed_fact(**tables, version="mimic-iii")) == plain


def test_fact_of_a_cohort(tables):
    got = job.processed_fact(**tables, version="mimic-iii", num_patients=2)
    assert [r["NOTE_PK"] for r in got.orderBy("row_id").collect()] == [1, 2, 5]


def test_cohort_order_and_missing_ids(tables, rows, plan):
    discharge = notes.discharge_notes(tables["notes"], MIMIC_III)
    everyone = [10, 11, 12, 13, 14]
    got = cohort.patient_cohort(discharge, 3)
    assert rows(got) == [(10,), (11,), (12,)]
    assert "TakeOrdered" not in plan(got)
    assert {r[0] for r in cohort.patient_cohort(discharge, 5).collect()} == {*everyone}
    assert {r[0] for r in cohort.patient_cohort(discharge, 6).collect()} == {*everyone, None}
    assert {r[0] for r in cohort.patient_cohort(discharge, 9).collect()} == {*everyone, None}
    assert {r[0] for r in cohort.patient_cohort(discharge, None).collect()} == {*everyone, None}
    kept = cohort.restrict_to_cohort(tables["diagnoses"], got)
    assert {r["SUBJECT_ID"] for r in kept.collect()} == {10, 11, 12}


def test_a_missing_note_key_is_a_key(tables):
    nameless = F.when(F.col("NOTE_PK") != 2, F.col("NOTE_PK")).alias("NOTE_PK")
    noted = tables["notes"].select(nameless, "SUBJECT_ID", "HADM_ID", "CATEGORY", "TEXT")
    got = job.processed_fact(**{**tables, "notes": noted}, version="mimic-iii")
    assert {r["NOTE_PK"]: r["TEXT"] for r in got.collect()} == {
        1: "first", None: "second", 5: "no procedures", 9: None
    }


def test_left_procedures_keep_notes_without_keys(tables):
    grouped = grouping.group_codes(tables["procedures"], MIMIC_III, "procedure_codes")
    got = fact.notes_left_procedures(tables["notes"], grouped, MIMIC_III)
    assert {r["NOTE_PK"]: r["procedure_codes"] for r in got.collect()} == {
        1: ["3893"], 2: ["3893"], 3: ["9671"], 4: [], 5: [], 6: [], 7: [], 8: [], 9: []
    }


def test_note_key(tables, rows):
    assert notes.with_note_key(tables["notes"], "mimic-iii", ["HADM_ID"]) is tables["notes"]
    bare = tables["notes"].drop("NOTE_PK").withColumn("place", F.length("TEXT")).filter("place > 0")
    got = notes.with_note_key(bare, MIMIC_III, ["place"])
    assert [k for k, _ in sorted(rows(got, "NOTE_PK", "place"), key=lambda r: r[1])] == list(
        range(1, bare.count() + 1)
    )
    iv = tables["notes"].drop("NOTE_PK")
    assert "NOTE_ID" in notes.with_note_key(iv.filter("TEXT = 'first'"), MIMIC_IV, ["TEXT"]).columns


def test_text_is_shuffled_only_by_the_note_key(tables, plan):
    text = plan(job.processed_fact(**tables, version="mimic-iii"))
    for line in text.splitlines():
        if "Exchange hashpartitioning" in line and "_file" not in line:
            assert "NOTE_PK" in line or "_key" in line or "_noted" in line


def test_lists_are_not_sorted_for_the_numbers(tables, plan):
    keys = job.staged_keys(**tables, version="mimic-iii")
    text = plan(job.row_numbers(keys, "mimic-iii"))
    assert "codes" not in text and "TEXT" not in text


def test_gender_join_splits_a_hot_patient(spark):
    hot = F.when(F.col("id") % 1_000 == 0, F.col("id") % 49).otherwise(1)
    df = spark.range(400_000).select(hot.alias("SUBJECT_ID"), "id")
    patients = spark.range(50).select(
        F.col("id").alias("SUBJECT_ID"), F.concat(F.lit("F"), F.col("id")).alias("GENDER")
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = fact.with_gender(df, patients)
        assert len(out.collect()) == 400_000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_texts_are_shuffled_once(spark):
    """Missing keys are keys, and the join deals out the texts by itself."""
    columns = "NOTE_PK long, SUBJECT_ID long, HADM_ID long, CATEGORY string"
    rows = [(1, 2, 3, "Discharge summary"), (None, 4, 5, "Discharge summary")]
    keys = spark.createDataFrame(rows, columns)
    notes = spark.createDataFrame([(*r, f"text {r[0]}") for r in rows], f"{columns}, TEXT string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = fact_operators.attach_text(keys, notes, "mimic-iii")
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert sorted(r["TEXT"] for r in df.collect()) == ["text 1", "text None"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

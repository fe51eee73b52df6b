"""The jobs end to end on a small literal dataset."""

import pytest
from pyspark.sql import functions as F

from codeprep.config import MIMIC_IV, PrepareSettings
from codeprep.plans import prepare, tokenise
from codeprep.sources import token_tables

PATIENTS = range(10, 40)


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    for sub in ("note", "hosp", "core"):
        (folder / sub).mkdir(parents=True)
    notes = ["subject_id,hadm_id,note_type,text"]
    codes = ["subject_id,hadm_id,seq_num,icd_code"]
    patients = ["subject_id,gender"]
    for p in PATIENTS:
        notes.append(f'{p},{p * 10},DS,"note of {p}\nsecond line"')
        notes.append(f"{p},{p * 10},RR,report")
        codes += [f"{p},{p * 10},{i},0{i}{p}" for i in (2, 1)]
        patients.append(f"{p},{'F' if p % 2 else 'M'}")
    (folder / "note/discharge.csv").write_text("\n".join(notes) + "\n")
    (folder / "hosp/diagnoses_icd.csv").write_text("\n".join(codes) + "\n")
    (folder / "hosp/procedures_icd.csv").write_text(codes[0] + "\n")
    (folder / "core/patients.csv").write_text("\n".join(patients) + "\n")
    return str(folder)


def test_prepare_and_tokenise(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    settings = PrepareSettings(version="mimic-iv", num_patients=20)
    fact = prepare.prepare(spark, raw, out, settings)
    got = fact.orderBy("row_id").collect()
    assert [r["SUBJECT_ID"] for r in got] == list(range(10, 30))
    assert [r["row_id"] for r in got] == list(range(1, 21))
    assert [r["split"] for r in got] == ["train"] * 16 + ["val"] * 2 + ["test"] * 2
    assert got[0]["diagnosis_codes"] == ["0110", "0210"] and got[0]["procedure_codes"] == []
    assert got[0]["TEXT"] == "note of 10\nsecond line" and got[0]["gender"] == "M"
    assert len({r["NOTE_ID"] for r in got}) == 20

    counts = {r["stage"]: r["n_rows"] for r in prepare.report(spark, out, "mimic-iv").collect()}
    assert counts == {
        "NOTEEVENTS": 60,
        "DIAGNOSES_ICD": 60,
        "PROCEDURES_ICD": 0,
        "PATIENTS": 30,
        "processed_data": 20,
        "train": 16,
        "val": 2,
        "test": 2,
        "examples": 20,
    }

    assert prepare.prepare(spark, raw, out, settings).count() == 20
    with pytest.raises(ValueError, match="other settings"):
        prepare.prepare(spark, raw, out, PrepareSettings(version="mimic-iv", num_patients=10))
    redo = PrepareSettings(version="mimic-iv", num_patients=10, overwrite=True, shuffled=True)
    assert prepare.prepare(spark, raw, out, redo).count() == 10
    prepare.prepare(spark, raw, out, PrepareSettings(version="mimic-iv", overwrite=True))

    tokenise.tokenise(spark, out, "mimic-iv", vocabulary_size=50, max_length=16)
    for split, size in (("train", 24), ("validation", 3), ("test", 3)):
        tokens = token_tables.read_tokens(spark, out, MIMIC_IV, split).collect()
        assert [r["id"] for r in tokens] == list(range(size))
        assert all(len(r["input_ids"]) == 16 and r["labels"] == r["input_ids"] for r in tokens)
    with pytest.raises(ValueError):
        token_tables.read_tokens(spark, out, MIMIC_IV, "dev")


def test_existing_note_keys_must_be_unique(spark, raw, tmp_path):
    from codeprep.sources.tables import ingest

    tables = ingest(spark, raw, str(tmp_path / "out"), "mimic-iv")
    tables["NOTEEVENTS"] = tables["NOTEEVENTS"].withColumn("NOTE_ID", F.lit("same"))
    with pytest.raises(ValueError, match="NOTE_ID=same"):
        prepare.load_notes(spark, tables, "mimic-iv")


def test_missing_note_keys_are_given(spark, raw, tmp_path):
    notes = spark.createDataFrame(
        [("a", 1), (None, 2), (None, 3)], "NOTE_ID string, SUBJECT_ID long"
    )
    notes.coalesce(1).write.parquet(str(tmp_path / "n"))
    stored = spark.read.parquet(str(tmp_path / "n"))
    found = prepare.load_notes(spark, {"NOTEEVENTS": stored}, "mimic-iv").collect()
    assert {r["SUBJECT_ID"]: r["NOTE_ID"] for r in found} == {1: "a", 2: "row-2", 3: "row-3"}
    numbered = stored.withColumn("NOTE_PK", F.when(F.col("NOTE_ID") == "a", 7).cast("long"))
    numbered.drop("NOTE_ID").write.parquet(str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    found = prepare.load_notes(spark, {"NOTEEVENTS": stored}, "mimic-iii").collect()
    assert {r["SUBJECT_ID"]: r["NOTE_PK"] for r in found} == {1: 7, 2: -2, 3: -3}


def test_a_job_leaves_no_scratch_tables(spark, raw, tmp_path):
    import os

    from codeprep.staging import checkpoint_dir

    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    settings = PrepareSettings(version="mimic-iv", num_patients=None)
    prepare.prepare(spark, raw, str(tmp_path / "out"), settings, shuffled_bytes=1 << 20)
    tokenise.tokenise(spark, str(tmp_path / "out"), "mimic-iv", 50, 16, shuffled_bytes=1 << 20)
    assert set(os.listdir(folder)) == before

import json

import pytest
from pyspark.sql import functions as F

from codeprep.config import MIMIC_III, MIMIC_IV, PrepareSettings, dataset_version, split_name
from codeprep.operators.audit import require_unique
from codeprep.sources import datasets, documents, facts, tables
from codeprep.staging import checkpoint_dir, staged
from registry import queries

NOTES = '''subject_id,hadm_id,category,text,chartdate
10,100,Discharge summary,"line one
line ""two"", with comma",2101-01-01
10,,Discharge summary,no admission,
'''
CODES = "row_id,subject_id,hadm_id,seq_num,icd9_code\n1,10,100,1,0389\n2,10,100,2,V3001\n"


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "NOTEEVENTS.csv").write_text(NOTES)
    (folder / "DIAGNOSES_ICD.csv").write_text(CODES)
    (folder / "PROCEDURES_ICD.csv").write_text(CODES)
    (folder / "PATIENTS.csv").write_text("subject_id,gender\n10,F\n")
    return folder


def test_ingest(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    got = tables.ingest(spark, str(raw), out, "mimic-iii")
    notes = got["NOTEEVENTS"].orderBy(F.desc("HADM_ID")).collect()
    assert got["NOTEEVENTS"].columns == ["SUBJECT_ID", "HADM_ID", "CATEGORY", "TEXT", "CHARTDATE"]
    assert notes[0]["TEXT"] == 'line one\nline "two", with comma'
    assert notes[1]["HADM_ID"] is None and notes[0]["SUBJECT_ID"] == 10
    assert [r["ICD9_CODE"] for r in got["DIAGNOSES_ICD"].orderBy("SEQ_NUM").collect()] == [
        "0389",
        "V3001",
    ]


def test_ingest_keeps_or_replaces(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    tables.ingest(spark, str(raw), out, "mimic-iii")
    (raw / "PATIENTS.csv").write_text("subject_id,gender\n10,M\n11,F\n")
    assert tables.ingest(spark, str(raw), out, "mimic-iii")["PATIENTS"].count() == 1
    assert tables.ingest(spark, str(raw), out, "mimic-iii", overwrite=True)["PATIENTS"].count() == 2


def test_missing_files_and_versions(spark, raw, tmp_path):
    (raw / "PATIENTS.csv").unlink()
    with pytest.raises(FileNotFoundError, match="PATIENTS.csv"):
        tables.ingest(spark, str(raw), str(tmp_path / "out"), "mimic-iii")
    with pytest.raises(FileNotFoundError):
        tables.ingest(spark, str(raw), str(tmp_path / "out"), "mimic-iv")
    with pytest.raises(ValueError):
        tables.ingest(spark, str(raw), str(tmp_path / "out"), "mimic-v")
    with pytest.raises(FileNotFoundError):
        facts.read_fact(spark, str(tmp_path / "none"), "mimic-iii")


def test_duplicate_patients_are_refused(spark, raw, tmp_path):
    (raw / "PATIENTS.csv").write_text("subject_id,gender\n10,M\n10,F\n")
    with pytest.raises(ValueError, match="SUBJECT_ID=10"):
        tables.ingest(spark, str(raw), str(tmp_path / "out"), "mimic-iii")
    require_unique(spark.range(5), ["id"], "range")


def test_layouts_and_names():
    assert {t: v.path for t, v in MIMIC_IV.layout.items()} == {
        "NOTEEVENTS": "note/discharge.csv",
        "DIAGNOSES_ICD": "hosp/diagnoses_icd.csv",
        "PROCEDURES_ICD": "hosp/procedures_icd.csv",
        "PATIENTS": "core/patients.csv",
    }
    assert dataset_version("MIMIC-III") is MIMIC_III and MIMIC_III.database == "mimic_iii"
    assert split_name("Validation") == "val"
    with pytest.raises(ValueError):
        split_name("dev")
    with pytest.raises(ValueError):
        PrepareSettings(num_patients=9)
    with pytest.raises(ValueError):
        PrepareSettings(seed=1.5)
    with pytest.raises(ValueError):
        PrepareSettings(version="mimic-ii")


def test_csv_examples(spark, raw):
    got = datasets.load_csv_examples(spark, str(raw), "mimic-iii").collect()
    assert len(got) == 1
    assert got[0]["codes"] == ["ICD-9:0389", "ICD-9:V3001"]
    assert got[0]["metadata"].asDict() == {
        "source": "mimic-iii",
        "hadm_id": 100,
        "subject_id": 10,
        "category": "Discharge summary",
    }
    with pytest.raises(FileNotFoundError):
        datasets.load_csv_examples(spark, str(raw), "mimic-iii", codes_table="other.csv")


def test_dataset_files(spark, tmp_path):
    records = [{"text": "a\nb", "n": 1}, {"text": "c", "n": 2}]
    (tmp_path / "d.json").write_text(json.dumps(records))
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, records)))
    (tmp_path / "d.csv").write_text('text,n\n"a\nb",1\nc,2\n')
    (tmp_path / "d.txt").write_text("x")
    for name, lines in (("d.json", False), ("l.json", True), ("d.csv", False)):
        got = datasets.load_dataset(spark, str(tmp_path / name), lines=lines)
        assert sorted((r["n"], r["text"]) for r in got.collect()) == [(1, "a\nb"), (2, "c")]
    typed = datasets.load_dataset(spark, str(tmp_path / "d.csv"), "text string, n string")
    assert dict(typed.dtypes) == {"text": "string", "n": "string"}
    with pytest.raises(ValueError, match="neither .csv nor .json"):
        datasets.load_dataset(spark, str(tmp_path / "d.txt"))
    with pytest.raises(FileNotFoundError):
        datasets.load_dataset(spark, str(tmp_path / "none.csv"))


def test_splits_are_pruned(spark, tmp_path, plan):
    path = facts.fact_path(str(tmp_path), "mimic-iii")
    label = F.when(F.col("id") % 3 == 0, "train").when(F.col("id") % 3 == 1, "val")
    df = spark.range(30).withColumn("split", label.otherwise("test"))
    facts.write_fact(df, path)
    one = facts.read_fact(spark, str(tmp_path), "mimic-iii", "validation")
    assert one.count() == 10
    assert "PartitionFilters: [isnotnull(split" in plan(one)
    facts.write_fact(df.limit(1), path, overwrite=False)
    assert facts.read_fact(spark, str(tmp_path), "mimic-iii").count() == 30


def test_numbers_in_float_form_and_rejects(spark, raw, tmp_path):
    (raw / "DIAGNOSES_ICD.csv").write_text(
        "subject_id,hadm_id,seq_num,icd9_code\n"
        "163353.0, 100 ,1.,0389\nabc,100,2,V1\n,,,E9\n10,1e3,3,X\n10,100,99999999999,Y\n"
        "-5,+7,1.000,Z\n1.5,2,3,W\n"
    )
    out = str(tmp_path / "out")
    good = tables.ingest(spark, str(raw), out, "mimic-iii")["DIAGNOSES_ICD"].collect()
    assert sorted((tuple(r) for r in good), key=repr) == sorted(
        [(163353, 100, 1, "0389"), (None, None, None, "E9"), (-5, 7, 1, "Z")], key=repr
    )
    bad = spark.read.parquet(tables.reject_path(out, "mimic-iii", "DIAGNOSES_ICD")).collect()
    told = {r["ICD9_CODE"]: (r[tables.REJECTED], r["SUBJECT_ID_AS_TEXT"]) for r in bad}
    assert told == {
        "V1": ("SUBJECT_ID", "abc"),
        "X": ("HADM_ID", "10"),
        "Y": ("SEQ_NUM", "10"),
        "W": ("SUBJECT_ID", "1.5"),
    }
    (raw / "DIAGNOSES_ICD.csv").write_text(CODES)
    tables.ingest(spark, str(raw), out, "mimic-iii", overwrite=True)
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(tables.reject_path(out, "mimic-iii", "DIAGNOSES_ICD")).collect()


def extractor():
    def pages(blob):
        if blob.startswith(b"bad"):
            raise ValueError("no pages")
        return [p.decode() or None for p in blob.split(b"|")]

    return pages


def test_documents_from_files(spark, tmp_path):
    files = {"a.pdf": b"one||two", "b.pdf": b"bad", "c.pdf": b"|", "d.txt": b"x"}
    for name, blob in files.items():
        (tmp_path / name).write_bytes(blob)
    got = {
        r["metadata"]["filename"]: r
        for r in documents.read_documents(spark, str(tmp_path), extractor()).collect()
    }
    assert set(got) == {"a.pdf", "b.pdf", "c.pdf"}
    assert got["a.pdf"]["content"] == "onetwo" and got["a.pdf"]["metadata"]["page_count"] == 3
    assert got["b.pdf"]["error"] == "Could not process PDF: no pages"
    assert got["c.pdf"]["content"] == "" and got["c.pdf"]["metadata"]["page_count"] == 2
    with pytest.raises(FileNotFoundError):
        documents.read_documents(spark, str(tmp_path / "none"), extractor())


def test_packs_are_read_like_files(spark, tmp_path):
    files = {"a.pdf": b"one||two", "b.pdf": b"bad", "c.pdf": b"|"}
    (tmp_path / "single").mkdir()
    for name, blob in files.items():
        (tmp_path / "single" / name).write_bytes(blob)
    rows = [(f"single/{n}", bytearray(b)) for n, b in files.items()]
    packs = spark.createDataFrame(rows, "path string, content binary").coalesce(1)
    packs.write.parquet(str(tmp_path / "packs"))

    def told(df):
        return {(r["metadata"]["filename"], r["content"], r["metadata"]["page_count"], r["error"]) for r in df.collect()}

    single = documents.read_documents(spark, str(tmp_path / "single"), extractor())
    packed = documents.read_packs(spark, str(tmp_path / "packs"), extractor())
    assert told(packed) == told(single) and packed.schema == single.schema
    with pytest.raises(FileNotFoundError):
        documents.read_packs(spark, str(tmp_path / "none"), extractor())


def test_files_do_not_grow_with_documents(spark, tmp_path, monkeypatch):
    texts = [(i, f"text {i}", "en") for i in range(500)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: str(tmp_path / name))
    assert queries.documents_from_files(spark, str(tmp_path)).count() == 510
    assert len(list((tmp_path / "files").rglob("part-*"))) < 50


def test_unchanged_files_are_written_once(spark, tmp_path, monkeypatch):
    notes = spark.createDataFrame([(1, 2, 3, "Radiology", "text")], "NOTE_PK long, SUBJECT_ID long, HADM_ID long, CATEGORY string, TEXT string")
    items = spark.createDataFrame([(2, 3, 1, "00001")], "SUBJECT_ID long, HADM_ID long, SEQ_NUM int, ICD9_CODE string")
    patients = spark.createDataFrame([(2, "F")], "SUBJECT_ID long, GENDER string")
    small = queries.ClinicalTables(MIMIC_III, notes, items, items, patients)
    made = []
    monkeypatch.setattr(queries, "clinical_tables", lambda *args: small)
    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: made.append(name) or str(tmp_path / f"{name}{len(made)}"))
    assert queries.ingest_skips_what_is_there(spark, "").collect() == [(2, "F", "?")]
    assert len(list(tmp_path.rglob("NOTEEVENTS.csv"))) == 1


def test_pages_in_order_with_gaps(spark):
    pages = spark.createDataFrame(
        [(1, 2, "b"), (1, 10, "c"), (1, 1, None), (2, 1, None)],
        "doc int, page_no int, text string",
    )
    whole = documents.concat_pages(pages, ["doc"]).collect()
    got = {r["doc"]: (r["content"], r["page_count"]) for r in whole}
    assert got == {1: ("bc", 3), 2: ("", 1)}


def test_staging_uses_the_session_folder(spark):
    folder = checkpoint_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or folder == named
    df = spark.range(5)
    back = staged(df, "range")
    assert back.count() == 5
    assert folder.rstrip("/") in back.inputFiles()[0]

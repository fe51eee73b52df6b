import random

import pytest
from pyspark.sql import functions as F

from codeprep.sources import quoted_csv, tables

SPLIT = "spark.sql.files.maxPartitionBytes"
OPEN = "spark.sql.files.openCostInBytes"


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in (SPLIT, OPEN)}
    yield lambda size: [spark.conf.set(k, str(size)) for k in before]
    for k, v in before.items():
        spark.conf.set(k, v)


def csv_text(seed, n, line_end):
    """Quotes, commas, blank lines and both kinds of line ends inside quotes; long values."""
    draw = random.Random(seed)
    bits = ["word ", '""', ",", "\n", "\r\n", "\n\n", "né ", '"",""', "\r", " ", "x" * 90]
    rows = ["id,text,more"]
    for i in range(n):
        text = "".join(draw.choices(bits, k=draw.choice([0, 1, 5, 40])))
        more = draw.choice(["", "plain", '"quoted, too"', '""'])
        rows.append(f'{i},"{text}",{more}')
        if i % 17 == 5:
            rows.append("")
    return line_end.join(rows) + draw.choice(["", line_end])


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
@pytest.mark.parametrize("size, n", [(150, 12), (211, 15), (4_000, 300), (1 << 27, 300)])
def test_equals_a_read_in_one_task(spark, rows, tmp_path, small_splits, size, n, line_end):
    path = tmp_path / "notes.csv"
    path.write_bytes(csv_text(size, n, line_end).encode())
    options = {"quote": '"', "escape": '"'}
    whole = spark.read.options(**options, header=True, multiLine=True).csv(str(path))
    expected = [tuple(r) for r in whole.collect()]
    small_splits(size)
    found = quoted_csv.read_quoted(spark, str(path), whole.schema, options)
    assert [tuple(r)[3:] for r in found.orderBy(*quoted_csv.PLACE).collect()] == expected
    splits = found.select("_split").distinct().count()
    assert splits > 2 or size > 100_000
    if size < 100_000:
        assert quoted_csv.split_lines(spark, str(path)).rdd.getNumPartitions() > 1


def test_folder_of_files(spark, rows, tmp_path, small_splits):
    """Each file has a header and starts anew; a value left open ends with its file."""
    (tmp_path / "a.csv").write_text('id,text\n1,"a\nb"\n2,"open\nto the end\n')
    (tmp_path / "b.csv").write_text('\nid,text\n3,"c ""d"""\n')
    (tmp_path / "c.csv").write_text("id,text\n")
    small_splits(20)
    found = tables.read_csv_table(spark, str(tmp_path), multiline=True)
    assert found.columns == ["ID", "TEXT"]
    assert rows(found) == [("1", "a\nb"), ("2", "open\nto the end"), ("3", 'c "d"')]


def test_notes_without_keys_are_written_in_file_order(spark, tmp_path, small_splits):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    notes = "".join(f'1,{i},Discharge summary,"note\n{i}"\n' for i in range(300))
    (raw / "NOTEEVENTS.csv").write_text("subject_id,hadm_id,category,text\n" + notes)
    for name in ("DIAGNOSES_ICD", "PROCEDURES_ICD"):
        (raw / f"{name}.csv").write_text("subject_id,hadm_id,seq_num,icd9_code\n1,1,1,a\n")
    (raw / "PATIENTS.csv").write_text("subject_id,gender\n1,F\n")
    small_splits(1024)
    from codeprep.plans.prepare import load_notes

    read = tables.ingest(spark, str(raw), str(out), "mimic-iii")
    key = tables.dataset_version("mimic-iii").note_key
    found = load_notes(spark, read, "mimic-iii").orderBy(key).select(key, "HADM_ID", "TEXT").collect()
    assert [tuple(r) for r in found] == [(i + 1, i, f"note\n{i}") for i in range(300)]


def test_no_window_over_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"a\nb"\n')
    lines = quoted_csv.split_lines(spark, str(tmp_path))
    plan = quoted_csv.split_states(lines)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
    assert lines.select(F.max("_split")).first()[0] == 0

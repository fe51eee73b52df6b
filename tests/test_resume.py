from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeprep.plans import resume, score

KEYS = ["id"]


@pytest.fixture
def documents(spark):
    rows = [(i if i % 19 else None, f"text {i}" if i % 7 else ("" if i % 2 else None)) for i in range(200)]
    rows += [(5, "same key")] * 40
    return spark.createDataFrame(rows, "id long, content string").repartition(3)


def counting_model(path):
    """Writes down every prompt; refuses some."""

    def answer(prompts):
        with open(path, "a", encoding="utf-8") as file:
            file.writelines(p.replace("\n", " ")[-12:] + "\n" for p in prompts)
        if any(p.endswith("13") for p in prompts):
            raise ValueError("no 13")
        return [f"{p} A-{len(p)}, B" for p in prompts]

    return answer


def asked(path):
    return Counter(path.read_text().splitlines()) if path.exists() else Counter()


COLUMNS = ["id", "codes", "model_version", "error", "predictions"]


def test_killed_after_half_the_parts(spark, documents, rows, tmp_path, monkeypatch):
    one, two = tmp_path / "one.txt", tmp_path / "two.txt"
    whole = score.score_documents(documents, KEYS, counting_model(str(one)), "v", batch_size=1)
    expected = rows(whole, *COLUMNS)
    real, entered = resume.enter, []

    def dies(spark, out_dir, part, n):
        if len(entered) == 4:
            raise KeyboardInterrupt
        entered.append(part)
        real(spark, out_dir, part, n)

    monkeypatch.setattr(resume, "enter", dies)
    args = (documents, KEYS, counting_model(str(two)), "v", str(tmp_path / "out"))
    with pytest.raises(KeyboardInterrupt):
        resume.score_in_parts(*args, parts=8, batch_size=1)
    monkeypatch.setattr(resume, "enter", real)
    before = asked(two)
    found = resume.score_in_parts(*args, parts=8, batch_size=1)
    assert rows(found, *COLUMNS) == expected
    assert sum(resume.ledger(spark, str(tmp_path / "out")).values()) == 240
    # Only the part that was not entered is asked a second time.
    texts = spark.read.parquet(str(tmp_path / "out" / "dealt"))
    again = texts.filter((F.col("_part") == 4) & (F.length("content") > 0)).count()
    assert asked(two) - asked(one) and sum(asked(two).values()) - sum(asked(one).values()) == again
    assert before and sum((asked(two) - before).values()) < sum(asked(two).values())
    # All is there: nothing more is asked, and the documents are not read.
    gone = documents.select("id", F.raise_error(F.lit("read again")).cast("string").alias("content"))
    same = resume.score_in_parts(gone, *args[1:], parts=8, batch_size=1)
    assert rows(same, *COLUMNS) == expected


def test_limited_calls_and_settings(spark, documents, rows, tmp_path):
    log = tmp_path / "log.txt"
    args = (documents, KEYS, counting_model(str(log)), "v", str(tmp_path / "out"))
    assert resume.score_in_parts(*args, parts=3, most=2) is None
    assert len(resume.ledger(spark, str(tmp_path / "out"))) == 2
    found = resume.score_in_parts(*args, parts=3, most=1)
    assert found.count() == 240
    with pytest.raises(ValueError, match="other settings"):
        resume.score_in_parts(*args, parts=4)
    resume.records_to_json(found, KEYS, str(tmp_path / "json"), "now")
    worked = found.filter("error IS NULL").count()
    assert spark.read.json(str(tmp_path / "json" / "responses")).count() == worked
    assert resume.score_in_parts(*args, parts=4, overwrite=True).count() == 240
    with pytest.raises(ValueError, match="parts"):
        resume.score_in_parts(*args, parts=0)


def test_empty_table(spark, documents, tmp_path):
    args = (documents.limit(0), KEYS, counting_model(str(tmp_path / "log")), "v", str(tmp_path / "out"))
    assert resume.score_in_parts(*args, parts=2).count() == 0

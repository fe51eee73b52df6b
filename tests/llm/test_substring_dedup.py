import hashlib
from collections import Counter

import pytest

from codeprep.llm import substring_dedup as S


def brute(rows, window):
    """Windows counted as tuples of words."""
    cut = [(d, (t or "").encode().split()) for d, t in rows]
    times = Counter(tuple(w[i : i + window]) for _, w in cut for i in range(len(w) - window + 1))
    out = []
    for d, w in cut:
        gone = set()
        for i in range(len(w) - window + 1):
            if times[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [35, 8, 5])
def test_report_equals_brute_force(odd_docs, all_rows, window):
    got = S.removal_report(odd_docs, window=window).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(all_rows, window)


def test_repeats_inside_one_text(spark, rows):
    part = " ".join(f"w{i}" for i in range(40))
    texts = [(1, f"{part} between {part}"), (2, "alone " + " ".join(f"v{i}" for i in range(50)))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(S.removal_report(docs)) == brute(texts, 35)


def test_cut_texts(odd_docs, no_docs, all_rows):
    cut = S.without_repeats(odd_docs)
    assert cut.columns == odd_docs.columns
    found = {r["doc_id"]: r["text"] for r in cut.select("doc_id", "text").collect()}
    texts = dict(all_rows)
    for d, n, gone, sha in brute(all_rows, 35):
        if not gone:
            assert found[d] == texts[d]
        else:
            words = found[d].encode().split()
            assert hashlib.sha256(b" ".join(words)).hexdigest() == sha
    assert found[4] == "" and found[1] is None and found[3] == " \n\t "
    assert S.without_repeats(no_docs).count() == 0
    assert S.removal_report(no_docs).count() == 0


def test_texts_are_hashed_once(odd_docs, monkeypatch):
    """The step that cuts texts reads them from a written table, not from the documents."""
    plans = {}

    def noted(df, name, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name, **options)

    stage = S.stage
    monkeypatch.setattr(S, "stage", noted)
    S.removal_report(odd_docs)
    assert plans["texts"].count("MapInArrow") == 1
    assert plans["cleaned"].count("MapInArrow") == 1


def test_kept_stretches_keep_their_blanks():
    words = [f"w{i}" for i in range(12)]
    text = "a  b\n" + " ".join(words) + "\tc   d"
    import numpy as np

    assert S.remaining(text.encode(), np.array([2]), 12) == "a  b\nc   d"


def test_a_window_needs_four_words(odd_docs):
    with pytest.raises(ValueError):
        S.removal_report(odd_docs, window=3)

import zlib

import numpy as np
import pytest

from codeprep.llm import classifier as C

from .conftest import prose


@pytest.fixture(scope="module")
def labelled(spark):
    """Prose (1) and shouting or symbol junk (0)."""
    rows, labels = [], []
    for i in range(240):
        good = i % 3 != 0
        text = prose(i, 40 + i)
        if not good:
            text = text.upper().replace(" ", "!! ") if i % 2 else text.replace(" ", "$%& ")
        rows.append((i, text))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_held_out_accuracy(labelled):
    docs, labels, truth = labelled
    rows = C.classified(docs, labels).collect()
    assert len(rows) == 240
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_held_out_labels_are_never_read(labelled, spark):
    docs, labels, truth = labelled
    wrong = [
        (d, 1 - y if zlib.crc32(str(d).encode()) % 3 == 1 else y) for d, y in truth.items()
    ]
    turned = spark.createDataFrame(wrong, "doc_id long, quality int")
    a = C.sample(docs, labels, "doc_id", "text", "quality")
    b = C.sample(docs, turned, "doc_id", "text", "quality")
    assert a[0] == b[0] and (a[1] == b[1]).all()


def test_pooling_equals_the_plain_sum():
    """Blocks and the split kernel change nothing: every window times every filter."""
    model = C.start(3)
    text = prose(5, 2_000).encode()
    data = C.padded(text)
    windows = np.array([
        model.vectors[data[i : i + C.WIDTH]].ravel() @ model.kernel + model.shift
        for i in range(0, len(data) - C.WIDTH + 1, C.STRIDE)
    ])
    tops = []
    for begin in range(0, max(1, len(data) - (C.CHUNK - C.STEP)), C.STEP):
        first = begin // C.STRIDE
        tops.append(np.maximum(windows[first : first + C.CHUNK // C.STRIDE - 1].max(0), 0))
    wanted = np.concatenate([np.mean(tops, 0), np.max(tops, 0)])
    assert np.allclose(C.pooled(text, model), wanted, atol=1e-4)


def test_a_long_text_in_blocks(monkeypatch):
    model = C.start(3)
    text = prose(6, 3_000).encode()
    whole = C.pooled(text, model)
    monkeypatch.setattr(C, "BLOCK_CHUNKS", 2)
    assert np.allclose(C.pooled(text, model), whole, atol=1e-4)


def test_odd_rows(labelled, odd_docs, no_docs, spark):
    _, labels, _ = labelled
    rows = C.classified(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert scores[1] == scores[2] and scores[4] == scores[5]
    assert C.classified(no_docs, labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in C.classified(odd_docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1), (None, 0), (5, None)], "doc_id long, quality int")
    assert min(r["score"] for r in C.classified(odd_docs, one).collect()) >= 0.5


def test_gradient_flow_lowers_the_loss():
    texts = [[prose(i, 60).encode()[: C.CHUNK]] for i in range(20)]
    texts += [[b"#$% " * 100] for _ in range(20)]
    labels = np.array([1] * 20 + [0] * 20)
    model = C.learn(texts, labels)
    assert min(C.chance(t[0], model) for t in texts[:20]) > 0.5
    assert max(C.chance(t[0], model) for t in texts[20:]) < 0.5

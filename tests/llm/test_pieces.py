import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeprep.llm import pieces as P

from .conftest import prose


@pytest.fixture(scope="module")
def table():
    return P.PieceTable.read()


def best_path(text, table):
    """Viterbi over the whole text, one character at a time; longer last pieces win ties."""
    known = dict(zip(table.pieces, zip(table.ids.tolist(), table.scores.tolist())))
    lowest = min(s for s in table.scores if s > -1e8) - P.UNKNOWN_PENALTY
    text = P.escaped(text)
    best = [(0.0, None)]
    for end in range(1, len(text) + 1):
        top = None
        for size in range(min(16, end), 0, -1):
            piece = text[end - size : end]
            if piece in known:
                ids, score = [known[piece][0]], known[piece][1]
            elif size == 1:
                ids = [int(table.byte_ids[b]) for b in piece.encode()]
                score = lowest
            else:
                continue
            value = best[end - size][0] + score
            if top is None or value > top[0]:
                top = (value, (end - size, ids))
        best.append(top)
    out, at = [], len(text)
    while at:
        at, ids = best[at][1]
        out = ids + out
    return out


TEXTS = [
    "", " ", "   ", "a", "\n", " \n ", "Hello  world.\n next, one's e.g. 3.14", "北京 🌊\t\u0000x",
    "tab\tand▁mark", "x" * 300, "été, déjà.", "....,,,.", ". a", "a .b ,c", prose(3, 120),
]


def pieces_of(spark, texts, table):
    """Piece ids of each text, through the whole operator."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = rows.select(F.struct("i").alias("row"), F.col("text").cast("binary").alias("body"))
    found = {r.row.i: r.ids for r in P.encoded_rows(rows, table).collect()}
    return [found[i] for i in range(len(texts))]


def test_lattice_equals_one_text_at_a_time(spark, table, monkeypatch):
    expected = [best_path(t, table) for t in TEXTS]
    assert pieces_of(spark, TEXTS, table) == expected
    # The same in small blocks, and with all but short words folded one by one.
    monkeypatch.setattr(P, "BLOCK_WORDS", 20)
    monkeypatch.setattr(P, "LATTICE", 4)
    assert pieces_of(spark, TEXTS, table) == expected


def test_places_come_back_from_their_packed_form():
    edges = [0, 191, 192, 447, 448, 12_479, 12_480, 77_000, 995_519, 995_520, 2**31 - 1]
    docs = [np.array(d, np.int32) for d in (edges, [], [5], range(400_000), edges[::-1], [])]
    places, bounds = P.opened_places(P.packed_places(docs))
    assert [places[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [d.tolist() for d in docs]
    # Words as frequent as in texts: less than the four bytes of each compressed together.
    draw = np.random.default_rng(7)
    zipf = [np.minimum(draw.zipf(1.2, 700) - 1, 300_000).astype(np.int32) for _ in range(50)]
    assert sum(map(len, P.packed_places(zipf))) < 0.9 * sum(len(P.squeezed(d)) for d in zipf)


def test_only_documents_and_values_stay_on_disk(spark, table, tmp_path, monkeypatch):
    """Words, and what is known of them, go when the blocks have the pieces."""
    monkeypatch.setattr(P, "scratch_path", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr("codeprep.llm.stage.scratch_path", P.scratch_path)
    found = pieces_of(spark, TEXTS, table)
    assert found == [best_path(t, table) for t in TEXTS]
    left = {f.relative_to(tmp_path).parts[:-1] for f in tmp_path.rglob("part-*")}
    assert left == {("word-blocks", "kind=docs"), ("values",)}


def test_a_block_of_empty_texts_after_another(spark, table):
    texts = ["some words", "", None, ""]
    rows = spark.sparkContext.parallelize(list(enumerate(texts)), 4)  # a block for each
    rows = spark.createDataFrame(rows, "i int, text string")
    rows = rows.select(F.struct("i").alias("row"), F.col("text").cast("binary").alias("body"))
    found = {r.row.i: (r.ids, r.same) for r in P.encoded_rows(rows, table).collect()}
    assert found == {0: (best_path(texts[0], table), True), **{i: ([], True) for i in (1, 2, 3)}}


def test_lattice_shuffles_no_edges(spark, table, plan):
    words = spark.createDataFrame([("ab",)], "word string").distinct()
    text = plan(P.best_paths(P.edges(words, table), table))
    exchanges = [line for line in text.split("*** Final")[0].splitlines() if "Exchange hash" in line]
    assert "BroadcastHashJoin" in text and len(set(exchanges)) <= 2


def test_long_unbroken_texts(spark, table):
    draw = random.Random(5)
    base64 = "".join(draw.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(200_000))
    cjk = "".join(chr(draw.randrange(0x4E00, 0x9FA5)) for _ in range(200_000))
    texts = ["x" * 200_000, base64, cjk, "x" * 700 + base64[:900] + cjk[:300]]
    found = pieces_of(spark, texts, table)
    assert found[3] == best_path(texts[3], table)
    body = P.body_of(table)
    for text, ids in zip(texts, found):
        assert b"".join(body[i] for i in ids).decode() == P.escaped(text)


def test_bytes_that_are_no_utf8(spark):
    docs = spark.sql("SELECT 1L doc_id, CAST(X'61FF62' AS STRING) text")
    row = P.round_trip(docs).first()
    assert row.round_trip is False and row.n_pieces == len(row.ids) > 0
    assert P.with_pieces(docs, "ids").count() == 1


def test_words_are_cut_where_no_piece_crosses(table):
    pattern = table.word_pattern()
    for text in TEXTS:
        assert "".join(pattern.findall(P.escaped(text))) == P.escaped(text)


def test_words_are_cut_at_every_place_that_no_piece_holds(table, monkeypatch):
    """So a word is the same one whatever stands after it."""
    known = set(table.neighbours().tolist())
    cutter = P.Cutter(table)
    for text in TEXTS:
        words = cutter.words(text)
        assert "".join(words) == P.escaped(text)
        assert not any(ord(a[-1]) << 21 | ord(b[0]) in known for a, b in zip(words, words[1:]))
        assert all(ord(a) << 21 | ord(b) in known for w in words for a, b in zip(w, w[1:]))
    assert {"▁word", "!"} <= set(cutter.words("word word! (word)"))
    found = [cutter.words(t) for t in TEXTS]
    monkeypatch.setattr(P, "TABLE_CHARS", 0)
    assert [P.Cutter(table).words(t) for t in TEXTS] == found


def test_round_trip(odd_docs, no_docs, all_rows):
    found = P.round_trip(odd_docs).collect()
    assert len(found) == len(all_rows)
    texts = {repr(d): t or "" for d, t in all_rows}
    for r in found:
        text = texts[repr(r["doc_id"])]
        assert r["round_trip"] == (P.SPACE not in text)
        assert r["n_pieces"] == len(r["ids"]) and bool(r["ids"]) == bool(text)
    assert P.round_trip(no_docs).count() == 0


def test_decoding_equals_the_library(spark, table):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    texts = [t for t in TEXTS if P.SPACE not in t]
    rows = [(i, model.encode(t)) for i, t in enumerate(texts)] + [(99, None), (100, [2, 10**6])]
    df = spark.createDataFrame(rows, "i int, ids array<int>")
    found = dict(df.select("i", P.decoded(F.col("ids"), table)).collect())
    assert [found[i] for i in range(len(texts))] == texts
    assert found[99] is None and set(found[100]) == {"�"}


def test_a_table_whose_pieces_cross_words(spark, table):
    own = P.PieceTable(["▁", "a", "b", "a▁b", "▁a"], np.arange(5, dtype=np.int32),
                       np.array([-1.0, -1.0, -1.0, -0.5, -3.0]), table.byte_ids, 0)
    assert pieces_of(spark, ["a b"], own) == [[0, 3]]

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from codeprep.llm import alignment as A

NAMES = ["doc_id", *A.COUNTS, "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=A.PIECES)


@pytest.fixture(scope="module")
def tok():
    with open(A.PIECES, "rb") as file:
        pieces = file.read()
    with open(A.BYTE_BPE, encoding="utf-8") as file:
        return A.Tokenizers(file.read(), pieces)


def slow_tokens(both, text):
    """(id, start, end) of both, from the libraries and a byte-level table of its own."""
    a, b = both
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    table = {chr(b): b for b in plain}
    table |= {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    if not text:
        return [], []
    found = a.encode(" " + text, add_special_tokens=False)
    mine = [(i, bytes(table[c] for c in t)) for i, t in zip(found.ids, found.tokens)]
    other = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        other.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(t for _, t in mine) != whole or b"".join(t for _, t in other) != whole:
        return [], []
    out = []
    for tokens in (mine, other):
        at, spans = 0, []
        for i, t in tokens:
            spans.append((i, at, at + len(t)))
            at += len(t)
        out.append(spans)
    return out


def slow_alignment(both, rows):
    docs, counts = [], Counter()
    for ident, text in rows:
        a, b = slow_tokens(both, text)
        links = []
        for x, s, e in a:
            links += [(x, y) for y, f, t in b if f < e and t > s]
        groups, ends = [], sorted({e for *_, e in a} & {e for *_, e in b})
        last = 0
        for end in ends:
            sides = [",".join(str(i) for i, s, e in side if last <= s and e <= end) for side in (a, b)]
            groups.append("|".join(sides))
            last = end
        counts.update(set(links))
        docs.append((ident, len(a), len(b), groups, links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(n, best.get(x, 0))
    return [
        (
            ident, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links),
            sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for ident, n_a, n_b, groups, links in docs
    ]


ODD = [
    (100, "<|endoftext|> <s> a </s> <unk> <0x41>"), (101, "a▁b"), (102, "   "), (103, "\n\n\t x  "),
    (104, "naïve 北京 🌊 ﬁne it's I'LL"), (105, "\u0000"), (106, " leading"), (107, "x"),
]


@pytest.mark.parametrize("at_once, pairs", [(1 << 20, 1 << 21), (3_000, 500)])
def test_equals_brute_force(spark, rows, both, odd_docs, all_rows, monkeypatch, at_once, pairs):
    monkeypatch.setattr(A, "BYTES_AT_ONCE", at_once)
    monkeypatch.setattr(A, "BLOCK_PAIRS", pairs)
    given = [r for r in all_rows if len(r[1] or "") < 20_000] + ODD
    docs = odd_docs.filter("length(text) < 20000 OR text IS NULL").select("doc_id", "text", "n", "key", "row")
    more = spark.createDataFrame([(*r, "x", "y", "z") for r in ODD], docs.schema)
    found = rows(A.token_alignment(docs.union(more)), *NAMES)
    assert found == sorted(slow_alignment(both, given), key=repr)


def test_long_text_and_bad_utf8(spark, both, all_rows):
    long = next(t for d, t in all_rows if d == 10)
    docs = spark.createDataFrame([(10, long)], "doc_id bigint, text string")
    docs = docs.union(spark.sql("SELECT 1L, CAST(X'61FF62' AS STRING)"))
    found = {r.doc_id: tuple(r) for r in A.token_alignment(docs).select(*NAMES).collect()}
    assert found[1] == (1, 0, 0, 0, 0, 0, 0, "")
    a, b = slow_tokens(both, long)
    common = {e for *_, e in a} & {e for *_, e in b}
    assert found[10][:4] == (10, len(a), len(b), len(common))
    assert found[10][4] == len(a) + len(b) - len(common)


def test_empty_table(no_docs):
    assert A.token_alignment(no_docs).count() == 0


def test_ids_are_those_of_the_public_library(tok, both):
    draw = random.Random(3)
    texts = ["".join(chr(draw.choice([32, 10, 39, 65, 97, 233, 0x4E2D, 0x1F600])) for _ in range(80)) for _ in range(200)]
    for text in texts:
        assert tok.a.encode_ordinary(" " + text) == both[0].encode(" " + text, add_special_tokens=False).ids


@pytest.mark.parametrize("n, m", [(1, 1), (5, 400), (300, 320), (400, 400)])
def test_gallop(n, m):
    draw = np.random.default_rng(n * m)
    long = np.sort(draw.choice(1000, m, replace=False))
    short = np.unique(np.append(draw.choice(long[-1] + 1, min(n, long[-1]), replace=False), long[-1]))
    place, hit = A.gallop(short, long)
    assert (place == np.searchsorted(long, short)).all()
    assert (hit == np.isin(short, long)).all()


def test_very_long_blank_runs(tok):
    text = b"a" + b" " * 1_000_000 + b"b"
    (a,), (b,) = tok.encode([text])
    assert len(a) and tok.a_size[a].sum() == tok.b_size[b].sum() == len(text) + 1


def test_ids_out_of_order_are_refused():
    model = {"added_tokens": [], "model": {"vocab": {"a": 0, "b": 1, "ab": 3, "abb": 2}, "merges": ["a b", "ab b"]}}
    with pytest.raises(ValueError, match="order"):
        A.byte_level_ranks(json.dumps(model))

"""Token counts that follow edits, and token ids in training order."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

from codeprep.llm import token_counts as T
from codeprep.llm import token_output as O
from codeprep.llm.tokenizer import PATTERN, Encoder, read_ranks

from .conftest import prose


@pytest.fixture(scope="module")
def whole():
    """The tokenizer library on whole texts."""
    return tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=read_ranks(), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return Encoder(read_ranks())


def test_ids_equal_the_library(whole, encoder, all_rows):
    for _, text in all_rows:
        ids = np.frombuffer(encoder.ids(text or ""), "<u2").tolist()
        assert ids == whole.encode_ordinary(text or "")


@pytest.mark.parametrize("leaf", [1, 4, 64])
def test_edits_equal_encoding_anew(whole, encoder, monkeypatch, leaf):
    monkeypatch.setattr(T, "LEAF", leaf)
    draw = random.Random(leaf)
    bits = ["", " ", "  \n", "a", "don't", " 12", "é!", "the end ", "\n\n\n", "x" * 30]
    for trial in range(60):
        text = prose(trial, draw.randrange(0, 90)) if trial % 4 else draw.choice(bits) * 3
        tree = T.SegmentTree.of(*encoder.spans(text))
        for _ in range(6):
            start = draw.randrange(-2, len(text) + 3)
            end = start + draw.choice([0, 0, 1, 5, 40, 500])
            put = draw.choice(bits)
            a = min(max(start, 0), len(text))
            b = min(max(end, a), len(text))
            wanted = text[:a] + put + text[b:]
            text, _ = T.edited(tree, text, (start, end, put), encoder)
            assert text == wanted
            assert tree.tokens[1] == len(whole.encode_ordinary(text))
            assert tree.chars[1] == len(text)
            heap = tree.tokens
            assert all(heap[i] == heap[2 * i] + heap[2 * i + 1] for i in range(1, tree.leaves))


def test_an_edit_reads_little_of_a_long_text(encoder):
    text = prose(1, 50_000)
    tree = T.SegmentTree.of(*encoder.spans(text))
    _, redone = T.edited(tree, text, (len(text) // 2, len(text) // 2 + 3, "zz"), encoder)
    assert redone <= 4 * T.LEAF


def test_counts(odd_docs, no_docs, all_rows, whole):
    found = T.token_counts(odd_docs, T.insert_and_delete(F.col("text"))).collect()
    wanted = []
    for d, t in all_rows:
        t = t or ""
        a, b = len(t) // 3, 2 * len(t) // 3
        new = t[:a] + t[:40] + t[a:]
        new = new[:b] + new[b + 25 :]
        sizes = [len(whole.encode_ordinary(x)) for x in (t, new)]
        wanted.append((repr(d), sizes[0], sizes[1], len(new)))
    names = ("n_tokens", "n_tokens_edited", "n_chars_edited")
    assert sorted((repr(r["doc_id"]), *(r[n] for n in names)) for r in found) == sorted(wanted)
    assert T.token_counts(no_docs, T.insert_and_delete(F.col("text"))).count() == 0


@pytest.mark.parametrize("total", [1, 2, 3, 5, 64, 1_000, 4_097])
def test_slots_are_a_permutation(total):
    numbers = np.arange(total)
    a = O.slots(numbers, total, 1)
    assert sorted(a.tolist()) == list(range(total))
    assert (O.slots(numbers[::-1], total, 1) == a[::-1]).all()
    if total > 60:
        assert (a != numbers).mean() > 0.9 and (O.slots(numbers, total, 2) != a).mean() > 0.9


def stream(rows, whole):
    """Tokens of all rows by id (null first), equal ids by their tokens' hash: unordered here."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [x for _, t in order for x in [*whole.encode_ordinary(t or ""), O.END]]


def test_shards_hold_the_stream(odd_docs, all_rows, whole, tmp_path):
    written = O.materialise(odd_docs, str(tmp_path / "s"), length=64, shard_size=16, key=5)
    rows = O.read_slots(written, 64).collect()
    tokens = stream(all_rows, whole)
    count = -(-len(tokens) // 64)
    assert sorted(r["slot"] for r in rows) == list(range(count))
    by_number = {r["sequence"]: r for r in rows}
    found = [by_number[i] for i in range(count)]
    flat = np.frombuffer(b"".join(bytes(r["tokens"]) for r in found), "<u2").tolist()
    assert flat[: len(tokens)] == tokens and set(flat[len(tokens) :]) <= {O.END}
    assert [r["slot"] for r in found] == O.slots(np.arange(count), count, 5).tolist()
    for r in rows:
        assert r["shard"] == r["slot"] // 16 and r["byte"] == r["slot"] % 16 * 128
    blocks = {r["shard"]: bytes(r["data"]) for r in written.collect()}
    for r in rows:
        assert blocks[r["shard"]][r["byte"] : r["byte"] + 128] == bytes(r["tokens"])
    assert all(len(b) == 16 * 128 for s, b in blocks.items() if s < max(blocks))
    later = O.read_slots(written, 64, first=40)
    assert sorted(r["slot"] for r in later.collect()) == list(range(40, count))


def test_ranges_cover_all_shards():
    for sequences, shard, tasks in [(0, 4, 8), (1, 4, 8), (33, 4, 8), (5_000, 16, 8), (10**7, 1, 3)]:
        count, each = O.ranges(sequences, shard, tasks)
        assert each <= O.RANGE_SHARDS and count * each * shard >= sequences
        assert (count - 1) * each * shard < max(sequences, 1)


def test_a_resumed_read_opens_later_ranges_only(odd_docs, plan, tmp_path):
    path = tmp_path / "s"
    written = O.materialise(odd_docs, str(path), length=16, shard_size=4, key=5)
    whole = {r["slot"]: r for r in O.read_slots(written, 16).collect()}
    files = sorted(path.glob("until=*/*.parquet"), key=lambda f: int(f.parent.name[6:]))
    assert len(files) == len(list(path.glob("until=*"))) > 2
    begin = 0
    for file in files:
        meta = pq.ParquetFile(file).metadata
        table = pq.ParquetFile(file).read()
        until = int(file.parent.name[6:])
        assert meta.num_row_groups == meta.num_rows
        assert table["first_slot"].to_pylist() == list(range(begin, min(until, len(whole)), 4))
        begin = until
    first = int(files[0].parent.name[6:]) + 1
    later = O.read_slots(written, 16, first)
    assert {r["slot"]: r for r in later.collect()} == {s: r for s, r in whole.items() if s >= first}
    shown = plan(later)
    assert "until#" in shown.split("PartitionFilters")[1].split("]")[0]
    assert f"GreaterThanOrEqual(last_slot,{first})" in shown
    at = F.input_file_name()
    read = written.filter(F.col("until") > first).select(at.alias("f")).distinct().collect()
    assert len(read) == len(files) - 1


def test_layout_of_the_input_does_not_matter(odd_docs, no_docs, rows):
    a = O.training_order(odd_docs, length=32, shard_size=8)
    b = O.training_order(odd_docs.repartition(7), length=32, shard_size=8)
    assert rows(a) == rows(b)
    assert O.training_order(no_docs).count() == 0


def test_edits_just_behind_a_leaf(encoder, monkeypatch):
    """With a pre-token a leaf, edits where a pre-token before them looked ahead."""
    monkeypatch.setattr(T, "LEAF", 1)
    cases = [("a\n\nWord Next", (3, 7, "")), ("so 'rx", (5, 6, "e")), ("x'", (2, 2, "re"))]
    draw = random.Random(7)
    for _ in range(4_000):
        text = "".join(draw.choices("\n\n  'reW1.", k=draw.randrange(12)))
        start = draw.randrange(len(text) + 1)
        put = "".join(draw.choices("\n 'reW1.", k=draw.randrange(4)))
        cases.append((text, (start, start + draw.randrange(4), put)))
    for text, edit in cases:
        tree = T.SegmentTree.of(*encoder.spans(text))
        new, _ = T.edited(tree, text, edit, encoder)
        chars, tokens = encoder.spans(new)
        assert (tree.chars[1], tree.tokens[1]) == (chars.sum(), tokens.sum()), (text, edit)

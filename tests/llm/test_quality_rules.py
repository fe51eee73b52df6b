import re
from collections import Counter

import pytest
import zstandard

from codeprep.llm import quality_rules as Q


def measured(text):
    """The counts, one character at a time."""
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = text.split("\n")
    dups = sum(bool(re.search("[^\x20\x09-\x0d]", s)) and s in lines[:i] for i, s in enumerate(lines))
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return (len(words), sum(map(len, words)), symbols, dups, len(inside), failed)


CASES = ["a b c a b c", "x\nx\n\n\n x\nx", "#| <a> $$%", "w " * 80, "é\x0bß\x0c1\n" * 3, "a b c"]


def test_counts_equal_brute_force(spark, odd_docs, all_rows):
    texts = [t for _, t in all_rows] + CASES
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    found = Q.with_quality(docs, "q").select("doc_id", "q.*").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in found} == {
        i: measured(t) for i, t in rows
    }


def test_bands(all_rows):
    packer = zstandard.ZstdCompressor(level=Q.LEVEL)
    verdict = {d: Q.judge((t or "").encode(), packer, Q.BANDS) for d, t in all_rows}
    assert verdict[4][-1] and verdict[10][-1]  # prose of 300 and of 30,000 words
    assert not verdict[14][-1] and not verdict[17][-1]  # repetitive
    noise = " ".join(f"{(i * 2654435761) % 2**32:08x}" for i in range(400))
    squeezed = Q.judge(noise.encode(), packer, [(None, 2.2, 9.0)])
    assert not squeezed[-2] and not squeezed[-1]  # base rules pass, hard to compress


def test_bad_chunks_reject_a_text_with_a_good_whole():
    packer = zstandard.ZstdCompressor(level=Q.LEVEL)
    words = [f"w{i}" for i in range(60)]
    text = (" ".join(words) + " ") * 60
    found = Q.judge(text.encode(), packer, [(None, 0.0, 1e9)])
    assert found[6] >= 2 and found[7] == found[6] and not found[-1]


def test_a_bad_tail_or_a_bad_third_rejects_a_text(all_rows):
    packer = zstandard.ZstdCompressor(level=Q.LEVEL)
    good = dict(all_rows)[10].encode()
    wide = [(None, 0.0, 1e9)]
    assert Q.judge(good[:8_000], packer, wide)[6:8] == (2, 0)
    tail = Q.judge(good[: 2 * Q.CHUNK] + b"same again " * 360, packer, wide)
    assert tail[6:8] == (3, 1) and not tail[-2] and not tail[-1]
    third = Q.judge(good[: 10 * Q.CHUNK] + b"same again " * 1_862, packer, wide)
    assert third[7] > 2 and not third[-2] and not third[-1]


def test_filter_keeps_columns_and_empty_tables(odd_docs, no_docs):
    kept = Q.quality_filter(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {4, 5, 10} <= {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert Q.quality_filter(no_docs).count() == 0


@pytest.mark.parametrize("size", [0, 256, 257, 10**9])
def test_every_length_has_a_band(size):
    low, high = Q.band_of(size, Q.BANDS)
    assert low < high

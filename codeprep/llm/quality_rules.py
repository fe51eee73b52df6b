"""Quality rules: plain counts, and zstandard ratios in bands that depend on length."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeprep.llm.stage import free_name

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
# Up to this many bytes: the lowest and the highest ratio (plain size over packed size) of a
# whole text. Longer texts share more context, so both limits rise with the length.
BANDS = (
    (256, 0.3, 3.0),
    (512, 1.15, 2.1),
    (1_024, 1.3, 2.15),
    (2_048, 1.5, 2.3),
    (4_096, 1.6, 2.35),
    (16_384, 1.75, 2.6),
    (65_536, 1.85, 2.9),
    (None, 1.9, 3.3),
)
CHUNK = 4_096
CHUNK_BAND = (1.4, 3.0)  # of chunks, which are all of one size
# Up to this many bytes: how many percent of a text's chunks may lie outside the band. In a
# short text one chunk is a large part.
BAD_CHUNKS = ((16_384, 0), (None, 12))
LEVEL = 3

RESULT = pa.struct(
    [
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("ratio", pa.float64()),
        ("n_chunks", pa.int64()),
        ("n_bad_chunks", pa.int64()),
        ("base_failed", pa.bool_()),
        ("kept", pa.bool_()),
    ]
)
RESULT_DDL = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,"
    "n_repeat_words:bigint,ratio:double,n_chunks:bigint,n_bad_chunks:bigint,"
    "base_failed:boolean,kept:boolean>"
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    grams = list(zip(words, words[1:], words[2:]))
    times = Counter(grams)
    if len(times) == len(grams):
        return 0
    covered = reach = 0
    for at, gram in enumerate(grams):
        if times[gram] > 1:
            covered += at + 3 - max(at, reach)
            reach = at + 3
    return covered


def duplicate_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    found = 0
    for line in text.split(b"\n"):
        if line in seen:
            found += 1
        elif line.split(None, 1):
            seen.add(line)
    return found


def ratio_of(data: bytes, packer: zstandard.ZstdCompressor) -> float:
    return len(data) / len(packer.compress(data))


def band_of(size: int, bands: Sequence[tuple]) -> tuple[float, float]:
    return next((low, high) for most, low, high in bands if most is None or size <= most)


def judge(text: bytes, packer: zstandard.ZstdCompressor, bands: Sequence[tuple]) -> tuple:
    """All measures of one text and the verdicts, in the order of ``RESULT``."""
    words = text.split()
    n = len(words)
    repeats = repeated_words(words)
    word_chars = len(text.translate(None, BLANKS + CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    ratio = ratio_of(text, packer)
    low, high = band_of(len(text), bands)
    # What is left at the end is judged in a last chunk that overlaps the one before; a text
    # below one chunk is judged by the narrow band of its whole.
    starts = list(range(0, len(text) - CHUNK + 1, CHUNK))
    if starts and len(text) % CHUNK:
        starts.append(len(text) - CHUNK)
    bad = sum(
        not CHUNK_BAND[0] <= ratio_of(text[at : at + CHUNK], packer) <= CHUNK_BAND[1]
        for at in starts
    )
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEATED_PERCENT * n
    most = next(percent for size, percent in BAD_CHUNKS if size is None or len(text) <= size)
    kept = not failed and low <= ratio <= high and 100 * bad <= most * len(starts)
    lines = duplicate_lines(text)
    return (n, word_chars, symbols, lines, repeats, ratio, len(starts), bad, failed, kept)


def quality(text: Column, bands: Sequence[tuple] = BANDS) -> Column:
    """The measures and verdicts of a text column as one struct.

    Null and empty texts have no words: all counts are 0, ``base_failed`` is true and
    ``kept`` false. A text is kept when it passes the base rules, its ratio lies in the
    band of its length, and no more of its ``CHUNK``-byte chunks lie outside ``CHUNK_BAND``
    than ``BAD_CHUNKS`` allows for its length; chunks cover a text to its end. Texts are taken as bytes, so broken UTF-8 is measured as it stands.
    Each row is judged alone: ties and repeated rows get equal verdicts.
    """
    bands = tuple(bands)

    @F.arrow_udf(RESULT_DDL)
    def measure(texts: pa.Array) -> pa.Array:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        rows = [judge(t.as_py() or b"", packer, bands) for t in texts]
        columns = list(zip(*rows)) or [()] * len(RESULT)
        return pa.StructArray.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, RESULT)], fields=list(RESULT)
        )

    return measure(text.cast("binary"))


def with_quality(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    """``docs`` with the struct of ``quality`` in a new column ``out``."""
    return docs.withColumn(out, quality(F.col(text)))


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text is kept, with the columns of ``docs`` whatever their names."""
    out = free_name("_quality", docs.columns)
    return with_quality(docs, out, text).filter(F.col(f"`{out}`.kept")).drop(out)

"""Removal of repeated passages, found level by level at doubling lengths.

A window of W words can only repeat if every window inside it repeats. So windows of about
W/4 words are looked at first, and of those only the one with the lowest hash in each window
of W words (both copies of a passage choose the same one). Those that occur once are done
with. Around the others, windows of twice the length are compared, then of W words, until
none is left or W is reached; each level reads what the level before has kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeprep.llm.grams import WordHashes, packed, pair, sequence_hash, unpacked, windows
from codeprep.llm.memory import releasing
from codeprep.llm.repeats import Flusher, repeated, schema
from codeprep.llm.stage import free_name, stage

WINDOW = 35
REMEMBERED_CLASSES = 100_000  # a class met again after so many others is only given out twice


class Levels:
    """Window hashes of one document at the three lengths."""

    def __init__(self, ids: np.ndarray, window: int):
        self.full, self.half = window, -(-window // 2)
        self.short = -(-self.half // 2)
        self.ids = ids
        self.shorts = windows(ids, self.short)

    @property
    def chosen(self) -> np.ndarray:
        """For each full window the place of its lowest short one, the first of equals."""
        span = self.full - self.short + 1
        view = np.lib.stride_tricks.sliding_window_view(self.shorts, span)
        places = np.empty(len(view), np.int64)
        for at in range(0, len(view), 100_000):  # bounded memory for very long texts
            places[at : at + 100_000] = view[at : at + 100_000].argmin(1)
        return places + np.arange(len(view))

    def halves(self) -> np.ndarray:
        shift = self.half - self.short
        return pair(self.shorts[: len(self.shorts) - shift], self.shorts[shift:])

    def fulls(self, halves: np.ndarray) -> np.ndarray:
        shift = self.full - self.half
        return pair(halves[: len(halves) - shift], halves[shift:])


def word_class(words: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, int]:
    """Word hashes, and one number for the whole sequence."""
    ids = hashes.of(words)
    return ids, sequence_hash(ids, kind=len(ids))


SEQUENCE = "struct<n:bigint,cls:bigint,sha:string>"


def sequence(text: Column) -> Column:
    """Number of words, class of equal word sequences, SHA-256 of the words joined by blanks."""

    def measure_batch(texts: pa.Array, hashes: WordHashes) -> pa.Array:
        n, cls, sha = [], [], []
        for t in texts:
            words = (t.as_py() or b"").split()
            n.append(len(words))
            cls.append(word_class(words, hashes)[1])
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sha, pa.string())],
            ["n", "cls", "sha"],
        )

    @F.arrow_udf(SEQUENCE)
    @releasing
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for texts in batches:
            yield measure_batch(texts, hashes)

    return measure(text.cast("binary"))


def short_windows(texts: DataFrame, window: int) -> DataFrame:
    """The chosen short windows of each class: (key, class, place, left, right).

    ``left`` and ``right`` are the windows of twice the length that end with and begin
    with the short one, 0 where the text has no room. ``texts`` has one binary column.
    """

    @releasing
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, out, seen = WordHashes(), Flusher(["left", "right"]), set()
        for batch in batches:
            for t in batch.column(0):
                words = (t.as_py() or b"").split()
                if len(words) < window:
                    continue
                ids, cls = word_class(words, hashes)
                if cls in seen:
                    continue
                seen.add(cls)
                levels = Levels(ids, window)
                places = np.unique(levels.chosen)
                halves = levels.halves()
                shift = levels.half - levels.short
                left, right = places - shift, places
                no_left, no_right = left < 0, right >= len(halves)
                full = out.add(
                    levels.shorts[places].view(np.int64),
                    np.full(len(places), cls),
                    places,
                    np.where(no_left, 0, halves[np.maximum(left, 0)].view(np.int64)),
                    np.where(no_right, 0, halves[np.minimum(right, len(halves) - 1)].view(np.int64)),
                )
                if full:
                    yield from out.flush()
                    seen.clear()
        yield from out.flush()

    return texts.mapInArrow(scan, schema(["left", "right"]))


def half_windows(kept: DataFrame) -> DataFrame:
    """The windows of twice the length around kept short ones: (key, class, 2 * place + side)."""

    @releasing
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Flusher()
        for batch in batches:
            cls = batch.column("a").to_numpy()
            place = batch.column("b").to_numpy()
            full = False
            for side, name in enumerate(("left", "right")):
                key = batch.column(name).to_numpy()
                some = key != 0
                full = out.add(key[some], cls[some], 2 * place[some] + side)
            if full:
                yield from out.flush()
        yield from out.flush()

    return kept.select("a", "b", "left", "right").mapInArrow(scan, schema())


def class_texts(docs: DataFrame, text: str, window: int) -> DataFrame:
    """(cls, body): packed texts of at least ``window`` words, each class once per task."""

    @releasing
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            if len(seen) > REMEMBERED_CLASSES:
                seen.clear()
            classes, bodies = [], []
            for t in batch.column(0):
                data = t.as_py() or b""
                words = data.split()
                if len(words) >= window:
                    cls = word_class(words, hashes)[1]
                    if cls not in seen:
                        seen.add(cls)
                        classes.append(cls)
                        bodies.append(packed(data))
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.int64()), pa.array(bodies, pa.binary())], ["cls", "body"]
            )

    binary = docs.select(F.col(text).cast("binary").alias("t"))
    return binary.mapInArrow(scan, "cls bigint, body binary")


def full_windows(found: DataFrame, window: int) -> DataFrame:
    """Windows of the asked length all of whose smaller windows looked at have repeated.

    ``found`` has cls, body and marks (2 * place + side of the kept half windows).
    """

    @releasing
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, out, seen = WordHashes(), Flusher(), set()
        for batch in batches:
            for cls, body, marks in zip(*(batch.column(c) for c in ("cls", "body", "marks"))):
                cls = cls.as_py()
                if cls in seen:
                    continue
                seen.add(cls)
                ids = hashes.of(unpacked(body.as_py()).split())
                levels = Levels(ids, window)
                marked = np.zeros(2 * len(ids) + 2, bool)
                marked[marks.values.to_numpy()] = True
                chosen = levels.chosen
                starts = np.arange(len(chosen))
                right_in = chosen <= starts + levels.full - levels.half
                left_in = chosen - (levels.half - levels.short) >= starts
                open_ = (marked[2 * chosen + 1] | ~right_in) & (marked[2 * chosen] | ~left_in)
                places = np.flatnonzero(open_)
                if len(places):
                    keys = levels.fulls(levels.halves())[places]
                    full = out.add(keys.view(np.int64), np.full(len(places), cls), places)
                    if full:
                        yield from out.flush()
                        seen.clear()
        yield from out.flush()

    return found.select("cls", "body", "marks").mapInArrow(scan, schema())


def gathered(rows: DataFrame, out: str) -> DataFrame:
    """(cls, list of places): at most a document's length in one list."""
    return rows.groupBy(F.col("a").alias("cls")).agg(F.collect_list("b").alias(out))


def repeated_windows(
    docs: DataFrame, text: str, window: int, texts_again: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(cls, starts) of the windows that also start elsewhere in another or the same text
    (copies of whole texts apart), and the packed class texts.

    With ``texts_again`` these are written, for a caller who reads them once more.
    """
    binary = docs.select(F.col(text).cast("binary").alias("t"))
    kept = stage(repeated(short_windows(binary, window), ["left", "right"]), "short")
    kept = stage(repeated(half_windows(kept)), "half").select("a", "b")
    texts = class_texts(docs, text, window)
    if texts_again:
        texts = stage(texts, "texts")
    found = texts.join(gathered(kept, "marks"), "cls")
    kept = stage(repeated(full_windows(found, window)).select("a", "b"), "full")
    return gathered(kept, "starts"), texts


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins at one of ``starts``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges[:-1]) > 0


def cleaned_classes(found: DataFrame, window: int) -> DataFrame:
    """(cls, n_removed, sha) of the classes that lose words."""

    @releasing
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            if len(seen) > REMEMBERED_CLASSES:
                seen.clear()
            classes, removed, shas = [], [], []
            for cls, body, starts in zip(*(batch.column(c) for c in ("cls", "body", "starts"))):
                cls = cls.as_py()
                if cls in seen:
                    continue
                seen.add(cls)
                words = unpacked(body.as_py()).split()
                gone = covered(len(words), starts.values.to_numpy(), window)
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                classes.append(cls)
                removed.append(len(words) - len(kept))
                shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())],
                ["cls", "n_removed", "sha"],
            )

    kind = "cls bigint, n_removed bigint, sha string"
    return found.select("cls", "body", "starts").mapInArrow(scan, kind)


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def removal_report(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256.

    A word goes when a window of ``window`` words over it also starts anywhere else, in
    the same or another row. Repeated rows are copies of each other, so all their words
    go. Null and empty texts and texts shorter than a window lose nothing. Ids may be null
    or repeat: rows are told apart by their words alone. An empty table gives an empty
    result; other columns are not looked at.
    """
    if window < 4:
        raise ValueError("a window needs at least 4 words")
    rows = docs.select(F.col(ident), sequence(F.col(text)).alias("_s"))
    rows = stage(rows.select(ident, "_s.*"), "sequences")
    starts, texts = repeated_windows(docs, text, window, texts_again=True)
    cleaned = stage(cleaned_classes(texts.join(starts, "cls"), window), "cleaned")
    cleaned = cleaned.dropDuplicates(["cls"]).withColumnRenamed("sha", "_sha")
    copies = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("_times"))
    copies = copies.filter("_times > 1").join(cleaned, "cls", "full")
    found = rows.join(copies, "cls", "left")
    copied = (F.col("_times") > 1) & (F.col("n") >= window)
    return found.select(
        ident,
        F.col("n").alias("n_words"),
        F.when(copied, F.col("n"))
        .otherwise(F.coalesce("n_removed", F.lit(0)))
        .cast("long")
        .alias("n_removed"),
        F.when(copied, F.lit(EMPTY_SHA)).otherwise(F.coalesce("_sha", "sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, all other columns as they are.

    The rule is that of ``removal_report``. What stays of a text keeps its own blanks and
    line breaks between neighbouring words; texts that lose nothing stay as they are, to
    the byte. A text that loses every word becomes empty.
    """
    starts, _ = repeated_windows(docs, text, window)
    cls, info = free_name("_cls", docs.columns), free_name("_seq", docs.columns)
    marks, times = free_name("_starts", docs.columns), free_name("_times", docs.columns)
    tagged = docs.withColumn(info, sequence(F.col(text)))
    tagged = tagged.withColumn(cls, F.col(f"{info}.cls"))
    narrow = docs.select(sequence(F.col(text)).alias("s")).select("s.cls", "s.n")
    copies = narrow.filter(F.col("n") >= window).groupBy("cls").agg(F.count(F.lit(1)).alias("t"))
    facts = copies.filter("t > 1").join(starts, "cls", "full")
    facts = stage(facts, "facts").select(
        F.col("cls").alias(cls), F.col("t").alias(times), F.col("starts").alias(marks)
    )

    @F.arrow_udf("string")
    def cut(texts: pa.Array, all_marks: pa.Array, copies_: pa.Array) -> pa.Array:
        out = []
        for t, found, n in zip(texts, all_marks, copies_):
            if n.as_py():
                out.append("")
            elif found.is_valid:
                out.append(remaining(t.as_py(), found.values.to_numpy(), window))
            else:
                out.append(t.as_py().decode("utf-8", "replace") if t.is_valid else None)
        return pa.array(out, pa.string())

    found = tagged.join(facts, cls, "left")
    changed = F.col(marks).isNotNull() | F.col(times).isNotNull()
    new = cut(F.when(changed, F.col(text).cast("binary")), F.col(marks), F.col(times))
    found = found.withColumn(text, F.when(changed, new).otherwise(F.col(text)))
    return found.select(*docs.columns)


def remaining(text: bytes, starts: np.ndarray, window: int) -> str:
    """The kept stretches of a text, each with its own blanks, joined by a line break."""
    words = text.split()
    gone = covered(len(words), starts, window).tolist()
    out, at, begin, end = [], 0, None, 0
    for word, g in zip(words, gone):
        here = text.index(word, at)
        at = here + len(word)
        if g:
            if begin is not None:
                out.append(text[begin:end])
            begin = None
        else:
            begin = here if begin is None else begin
            end = at
    if begin is not None:
        out.append(text[begin:end])
    return b"\n".join(out).decode("utf-8", "replace")

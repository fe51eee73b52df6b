"""Which tokens of two tokenizers cover the same bytes, and how often their ids meet.

Both tokenizers cut the same bytes, so each gives a rising list of byte offsets where its
tokens end. The shorter list is looked up in the longer one by galloping: from a place below,
in steps that double, then by halving. Common ends cut both token lists into groups. The
places found are ranks: the difference between the rank of a token's end and that of its
start is the range of the other list's tokens that overlap it.

How many documents hold a pair of ids linked is counted over the corpus. A task counts the
distinct pairs of a block of documents first; blocks are then added up by pair, and the sums
come back to each block once (``block_values``).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from codeprep.llm.block_values import first_block, with_values
from codeprep.llm.memory import releasing
from codeprep.llm.stage import stage
from codeprep.llm.tokenizer import PATTERN

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONG_BLANK = 50_000
BLANK_RUN = re.compile(rf"\s{{{LONG_BLANK}}}")
LANE = 8  # values that gallop from the place of the first of them
BYTES_AT_ONCE = 1 << 20  # texts are aligned together up to this size; a longer one is alone
BLOCK_PAIRS = 1 << 21  # pairs of documents and ids in a block: 12 bytes each


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value of ``short``: the first place in ``long`` not below it; whether equal.

    Both rise, and the last of ``long`` is not below any of ``short``.
    """
    heads = np.searchsorted(long, short[::LANE])
    low = np.repeat(heads, LANE)[: len(short)]
    last = len(long) - 1
    step = np.ones(len(short), np.int64)
    going = np.flatnonzero(long[low] < short)
    high = low.copy()
    while len(going):
        probe = np.minimum(low[going] + step[going], last)
        below = long[probe] < short[going]
        high[going] = probe
        going = going[below]
        low[going] = probe[below] + 1
        step[going] *= 2
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) >> 1
        below = long[middle] < short[going]
        low[going[below]] = middle[below] + 1
        high[going[~below]] = middle[~below]
        going = going[low[going] < high[going]]
    return low, long[low] == short


def byte_level_ranks(vocabulary_file: str) -> dict[bytes, int]:
    """Tokens as bytes with their ids; a vocabulary whose ids do not follow its merges is refused."""
    model = json.loads(vocabulary_file)
    special = {t["id"] for t in model["added_tokens"]}
    vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
    # Printable bytes stand for themselves, the others for characters from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    value = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    parts = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    made = [vocabulary["".join(p)] for p in parts]
    if made != sorted(made):
        raise ValueError("the ids of the vocabulary are not in the order of its merges")
    return {bytes(value[c] for c in t): i for t, i in vocabulary.items() if i not in special}


class Tokenizers:
    """Both tokenizers, and their tokens as bytes; made once in each task."""

    def __init__(self, vocabulary_file: str, pieces: bytes):
        import sentencepiece

        ranks = byte_level_ranks(vocabulary_file)
        self.vocabulary_file = vocabulary_file
        self.a = tiktoken.Encoding(
            "ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)])
            if self.b.is_byte(i)
            else self.b.id_to_piece(i).replace(SPACE, " ").encode()
            for i in range(len(self.b))
        ]
        self.a_size = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], np.int64)
        n = max(len(self.a_bytes), len(self.b_bytes))
        self.n_b, self.n_shown = len(self.b_bytes), n
        self.shown = [b"%d%s" % (i, sign) for sign in (b",", b"|", b";") for i in range(n)]

    def a_ids(self, text: str) -> list[int]:
        """Ids of the byte-level vocabulary; the faster library gives up on very long blank runs."""
        if len(text) < LONG_BLANK or not BLANK_RUN.search(text):
            return self.a.encode_ordinary(text)
        from tokenizers import Tokenizer

        slow = Tokenizer.from_str(self.vocabulary_file)
        slow.encode_special_tokens = True
        return slow.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text by both; none where either does not give the bytes back."""
        a, b = [], []
        none = np.empty(0, np.int64)
        strings = [t.decode("utf-8", "replace") for t in texts]
        for text, string, ids in zip(texts, strings, self.b.encode(strings, num_threads=1)):
            a.append(none)
            b.append(none)
            whole = b" " + text
            if not text or b"".join(map(self.b_bytes.__getitem__, ids)) != whole:
                continue
            other = self.a_ids(" " + string)
            if b"".join(map(self.a_bytes.__getitem__, other)) == whole:
                a[-1], b[-1] = np.array(other, np.int64), np.array(ids, np.int64)
        return a, b


def grouped(hit: np.ndarray) -> np.ndarray:
    """The number of each token's group, given which tokens end one."""
    return np.cumsum(hit) - hit


def aligned(tok: Tokenizers, texts: list[bytes]) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each text, and its distinct linked pairs (a * n_b + b): how many, which, how often."""
    a_lists, b_lists = tok.encode(texts)
    n_a = np.array([len(x) for x in a_lists])
    n_b = np.array([len(x) for x in b_lists])
    a, b = np.concatenate(a_lists), np.concatenate(b_lists)
    none = np.zeros(len(texts), np.int64)
    if not len(a):
        counts = {"n_a": n_a, "n_b": n_b, "n_groups": none, "n_links": none}
        return counts | {"sha": [""] * len(texts)}, none, np.empty(0, np.int64), np.empty(0, np.int32)
    # One text's ends follow the last one's: every text ends on a common end.
    a_end, b_end = np.cumsum(tok.a_size[a]), np.cumsum(tok.b_size[b])
    a_text, b_text = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
    by_a = len(a) <= len(b)
    place, hit = gallop(a_end, b_end) if by_a else gallop(b_end, a_end)
    low = np.concatenate([[0], (place + hit)[:-1]])
    links = place - low + 1
    mine = np.repeat(np.arange(len(place)), links)
    other = np.arange(len(mine)) - np.repeat(np.cumsum(links) - links - low, links)
    of_a, of_b = (mine, other) if by_a else (other, mine)
    span = len(tok.a_bytes) * tok.n_b
    keys = a_text[of_a] * span + a[of_a] * tok.n_b + b[of_b]
    pairs, times = np.unique(keys, return_counts=True)
    held = np.bincount(pairs // span, minlength=len(texts))

    ends = [np.zeros(len(a), bool), np.zeros(len(b), bool)]
    ends[not by_a][hit] = True
    ends[by_a][place[hit]] = True
    a_hit, b_hit = ends
    a_last, b_last = np.flatnonzero(a_hit), np.flatnonzero(b_hit)
    # The ids of all groups in one row: those of a, then those of b.
    shown = np.empty(len(a) + len(b), np.int64)
    before = np.concatenate([[0], b_last[:-1] + 1])
    shown[np.arange(len(a)) + before[grouped(a_hit)]] = a + tok.n_shown * a_hit
    shown[np.arange(len(b)) + a_last[grouped(b_hit)] + 1] = b + 2 * tok.n_shown * b_hit
    bounds = np.cumsum(n_a + n_b)
    sha = []
    for start, end in zip((bounds - n_a - n_b).tolist(), bounds.tolist()):
        row = b"".join(map(tok.shown.__getitem__, shown[start:end].tolist()))[:-1]
        sha.append(hashlib.sha256(row).hexdigest() if row else "")
    counts = {
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": np.bincount(a_text[a_hit], minlength=len(texts)),
        "n_links": np.bincount(a_text[of_a], minlength=len(texts)),
        "sha": sha,
    }
    return counts, held, pairs % span, times.astype(np.int32)


class Block:
    """The documents of one block and their pairs, until it is full."""

    def __init__(self, number: int):
        self.number = number
        self.rows: list[pa.RecordBatch] = []
        self.held: list[np.ndarray] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0

    def add(self, rows: pa.RecordBatch, held: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        for to, what in ((self.rows, rows), (self.held, held), (self.pairs, pairs), (self.times, times)):
            to.append(what)
        self.size += len(pairs) + len(held)

    def batches(self, schema: pa.Schema, names: list[str]) -> Iterator[pa.RecordBatch]:
        """Rows of documents with places of their pairs, and rows with the block's pairs."""
        if not self.rows:
            return
        keys, spots, docs = np.unique(
            np.concatenate(self.pairs), return_inverse=True, return_counts=True
        )
        spots, times = spots.astype("<i4"), np.concatenate(self.times).astype("<i4")
        ends = np.cumsum(np.concatenate(self.held))
        table = pa.Table.from_batches(self.rows)
        for at in range(0, table.num_rows, 2_000):
            some = table.slice(at, 2_000)
            bounds = [int(ends[at - 1]) if at else 0, *ends[at : at + 2_000].tolist()]
            slices = list(zip(bounds[:-1], bounds[1:]))
            columns = {n: some.column(n).combine_chunks() for n in names}
            columns |= {
                "block": pa.array([self.number] * some.num_rows, pa.int64()),
                "spots": pa.array([spots[x:y].tobytes() for x, y in slices], pa.binary()),
                "times": pa.array([times[x:y].tobytes() for x, y in slices], pa.binary()),
            }
            yield padded(columns, schema)
        for at in range(0, len(keys), 50_000):
            columns = {
                "block": pa.array([self.number], pa.int64()),
                "base": pa.array([at], pa.int32()),
                "pairs": pa.array([keys[at : at + 50_000]], pa.list_(pa.int64())),
                "docs": pa.array([docs[at : at + 50_000].astype(np.int32)], pa.list_(pa.int32())),
            }
            yield padded(columns, schema)


def padded(columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of ``schema`` whose other columns are null."""
    n = len(next(iter(columns.values())))
    arrays = [
        columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def steps(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in turn, as many at a time as have ``BYTES_AT_ONCE``; where each lot starts."""
    start, lot, size = 0, [], 0
    for i, t in enumerate(texts):
        value = t.as_py() or b""
        if lot and size + len(value) > BYTES_AT_ONCE:
            yield start, lot
            start, lot, size = i, [], 0
        lot.append(value)
        size += len(value)
    if lot:
        yield start, lot


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def tokenized(
    docs: DataFrame, ident: str, text: str, a_path: str, b_path: str
) -> DataFrame:
    """The staged blocks: rows of documents (``docs`` null) and rows of pairs (``pairs`` not null)."""
    with open(a_path, encoding="utf-8") as file:
        vocabulary_file = file.read()
    byte_level_ranks(vocabulary_file)
    with open(b_path, "rb") as file:
        pieces = file.read()
    given = docs.select(F.col(ident).alias("ident"), F.col(text).cast("binary").alias("body"))
    names = ["ident", *COUNTS, "sha"]
    kind = given.select(
        "ident",
        *[F.lit(0).cast("long").alias(c) for c in COUNTS],
        F.lit("").alias("sha"),
        F.lit(0).cast("long").alias("block"),
        F.lit(b"").alias("spots"),
        F.lit(b"").alias("times"),
        F.lit(0).alias("base"),
        F.array(F.lit(0).cast("long")).alias("pairs"),
        F.array(F.lit(0)).alias("docs"),
    ).schema
    for field in kind:
        field.nullable = True
    schema = to_arrow_schema(kind)
    kept = pa.schema([schema.field(n) for n in names])

    @releasing
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizers(vocabulary_file, pieces)
        block = Block(first_block())
        for batch in batches:
            for start, lot in steps(batch.column("body")):
                counts, held, pairs, times = aligned(tok, lot)
                columns = {"ident": batch.column("ident").slice(start, len(lot))}
                columns |= {n: pa.array(counts[n]) for n in [*COUNTS, "sha"]}
                block.add(padded(columns, kept), held, pairs, times)
                if block.size >= BLOCK_PAIRS:
                    yield from block.batches(schema, names)
                    block = Block(block.number + 1)
        yield from block.batches(schema, names)

    return stage(given.mapInArrow(scan, kind), "token-blocks")


def pair_counts(blocks: DataFrame, n_b: int) -> DataFrame:
    """(block, spot, n, best): documents that hold each pair of a block, and whether no pair
    of its a id has more. An a id has at most as many pairs as there are b ids."""
    rows = blocks.filter("pairs IS NOT NULL").select(
        "block", "base", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "z")
    )
    rows = rows.select("block", (F.col("base") + F.col("at")).alias("spot"), "z.*")
    sums = rows.groupBy("pairs").agg(F.sum("docs").alias("n"))
    of_a = Window.partitionBy(F.expr(f"pairs div {n_b}"))
    sums = sums.select("pairs", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))
    return rows.join(sums, "pairs").select("block", "spot", "n", "best")


def token_alignment(
    docs: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    a_path: str = BYTE_BPE,
    b_path: str = PIECES,
) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A blank is put before every text. Texts that are null, empty or no UTF-8, or whose tokens
    do not give their bytes back (such as texts with U+2581) have no tokens: zeros and ''.
    Strings of special tokens are plain text. ``n_best`` counts links whose pair is held by as
    many documents as any pair of its a id, ties included; ``count_sum`` adds the number of
    documents that hold each link's pair. Repeated rows are documents of their own. An empty
    table gives an empty result; other columns are not looked at. One text's tokens are held
    in one task.
    """
    import sentencepiece

    n_b = len(sentencepiece.SentencePieceProcessor(model_file=b_path))
    blocks = tokenized(docs, ident, text, a_path, b_path)
    values = pair_counts(blocks, n_b)
    rows = blocks.filter("spots IS NOT NULL").select(
        "block", "ident", *COUNTS, "sha", F.col("spots").alias("_spots"), "times"
    )
    out = ["ident", *COUNTS, "n_best", "count_sum", "sha"]
    zero = F.lit(0).cast("long")
    kind = rows.select("ident", *COUNTS, zero.alias("n_best"), zero.alias("count_sum"), "sha").schema

    def use(values: pa.RecordBatch | None, part: pa.RecordBatch) -> pa.RecordBatch:
        best, total = [], []
        if values is not None:
            n = values.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            top = values.column("best").to_numpy(zero_copy_only=False).astype(bool)
        for spots, times in zip(part.column("_spots").to_pylist(), part.column("times").to_pylist()):
            at, often = np.frombuffer(spots, "<i4"), np.frombuffer(times, "<i4").astype(np.int64)
            best.append(int(often[top[at]].sum()) if len(at) else 0)
            total.append(int((often * n[at]).sum()) if len(at) else 0)
        columns = {c: part.column(c) for c in ["ident", *COUNTS, "sha"]}
        columns |= {"n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        return pa.RecordBatch.from_arrays([columns[c] for c in out], out)

    found = with_values(rows, values, use, kind)
    return found.select(
        F.col("ident").alias(ident), *COUNTS, "n_best", "count_sum", F.col("sha").alias("groups_sha256")
    )

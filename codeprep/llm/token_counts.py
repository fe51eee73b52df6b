"""Token counts that follow edits: a segment tree of pre-tokens per document.

Leaves are runs of ``LEAF`` pre-tokens and hold their characters and tokens; inner nodes
hold sums. An edit re-encodes from the leaf before it until the pre-tokens fall in step
with the old ones at the end of a leaf, and then updates the sums above those leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeprep.llm.tokenizer import RANKS, Encoder, read_ranks

LEAF = 64
# Characters behind a pre-token that decide its end: "'re" for "'", "\n\nW" for the first "\n".
LOOK_AHEAD = 2


@dataclass
class SegmentTree:
    """Heaps of sums; node 1 is the root, leaf i is node ``leaves + i``."""

    chars: np.ndarray
    tokens: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.chars) // 2

    @classmethod
    def of(cls, chars: np.ndarray, tokens: np.ndarray) -> SegmentTree:
        """From the lengths and token numbers of single pre-tokens."""
        starts = np.arange(0, len(chars), LEAF)
        leaves = 1 << max(len(starts) - 1, 0).bit_length()
        heaps = []
        for values in (chars, tokens):
            heap = np.zeros(2 * leaves, np.int64)
            if len(starts):
                heap[leaves : leaves + len(starts)] = np.add.reduceat(values, starts)
            level = leaves
            while level > 1:
                heap[level // 2 : level] = heap[level : 2 * level : 2] + heap[level + 1 : 2 * level : 2]
                level //= 2
            heaps.append(heap)
        return cls(*heaps)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and where the leaf begins."""
        node, begin = 1, 0
        while node < self.leaves:
            node *= 2
            if at - begin >= self.chars[node]:
                begin += int(self.chars[node])
                node += 1
        return node - self.leaves, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.leaves
        more = (chars - int(self.chars[node]), tokens - int(self.tokens[node]))
        while node:
            self.chars[node] += more[0]
            self.tokens[node] += more[1]
            node //= 2


def edited(tree: SegmentTree, text: str, edit: tuple, encoder: Encoder) -> tuple[str, int]:
    """Replace characters start..end by a text; the new text and the pre-tokens re-encoded.

    Places beyond the text mean its end; an end before the start means the start.
    """
    start = min(max(edit[0], 0), len(text))
    end = min(max(edit[1], start), len(text))
    new = text[:start] + edit[2] + text[end:]
    grown = len(new) - len(text)
    # The pre-token before the edit may go on into it, and one that ends a leaf looked two
    # characters ahead: it stands only if those lie before the edit.
    first, begin = tree.find(max(start - LOOK_AHEAD, 0))
    last, close = first, begin + int(tree.chars[tree.leaves + first])
    chars = tokens = done = 0
    at = begin
    for stop, count in encoder.pre_tokens(new, begin):
        done += 1
        tokens += count
        at = stop
        # Old leaf ends behind the edit, moved by what the edit added.
        while (close < end or close + grown < at) and last < tree.leaves - 1:
            last += 1
            close += int(tree.chars[tree.leaves + last])
        if close >= end and close + grown == at:
            break
    else:
        last = tree.leaves - 1
    chars = at - begin
    for leaf in range(first + 1, last + 1):
        tree.put(leaf, 0, 0)
    tree.put(first, chars, tokens)
    return new, done


COUNTS = (
    "struct<n_tokens:bigint,n_pretokens:bigint,n_tokens_edited:bigint,"
    "n_chars_edited:bigint,n_reencoded:bigint>"
)


def counted(text: Column, edits: Column, ranks: dict[bytes, int]) -> Column:
    """Token counts of a text and of the same text after its edits, one after the other.

    ``edits`` is array<struct<start:int,end:int,put:string>>; each refers to the text as
    the edits before it left it. Null texts are empty, null edits none, a null ``put``
    deletes. Bytes that are no UTF-8 become U+FFFD.
    """

    def count_batch(texts: pa.Array, changes: pa.Array, encoder: Encoder) -> pa.Array:
        rows = []
        for value, edits_ in zip(texts, changes):
            body = (value.as_py() or b"").decode("utf-8", "replace")
            chars, tokens = encoder.spans(body)
            tree = SegmentTree.of(chars, tokens)
            whole = int(tree.tokens[1])
            redone = 0
            for e in edits_.as_py() or ():
                put = (e["put"] or b"").decode("utf-8", "replace")
                change = (e["start"] or 0, e["end"] or 0, put)
                body, n = edited(tree, body, change, encoder)
                redone += n
            rows.append((whole, len(chars), int(tree.tokens[1]), int(tree.chars[1]), redone))
        columns = list(zip(*rows)) or [()] * 5
        names = ["n_tokens", "n_pretokens", "n_tokens_edited", "n_chars_edited", "n_reencoded"]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    @F.arrow_udf(COUNTS)
    def count(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encoder = Encoder(ranks)
        for texts, changes in batches:
            yield count_batch(texts, changes, encoder)

    as_bytes = F.transform(
        edits, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["put"].cast("binary").alias("put"))
    )
    return count(text.cast("binary"), as_bytes)


def token_counts(
    docs: DataFrame,
    edits: Column,
    ident: str = "doc_id",
    text: str = "text",
    ranks_path: str = RANKS,
) -> DataFrame:
    """One row per row of ``docs``: id and the counts before and after ``edits``.

    Every text is encoded whole once; an edit costs what it touches. Null and empty texts
    have 0 tokens; bytes that are no UTF-8 count as U+FFFD. Rows are handled alone, so repeated rows get equal counts; an empty
    table gives an empty result; other columns are not looked at.
    """
    found = docs.select(
        F.col(ident), counted(F.col(text), edits, read_ranks(ranks_path)).alias("_c")
    )
    return found.select(ident, "_c.*")


def insert_and_delete(text: Column, insert: int = 40, delete: int = 25) -> Column:
    """Two edits per text: its own beginning put in at a third, some taken out at two thirds."""
    body = F.coalesce(text, F.lit(""))
    n = F.length(body)
    third, two = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
    edit = lambda a, b, put: F.struct(a.alias("start"), b.alias("end"), put.alias("put"))
    return F.array(
        edit(third, third, F.substring(body, 1, insert)),
        edit(two, two + delete, F.lit("")),
    )

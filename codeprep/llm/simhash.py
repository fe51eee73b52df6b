"""SimHash fingerprints of word shingles, and the groups of those that are close.

Two fingerprints link when they differ in at most two bits. Candidates come from a ring of
five segments: if two fingerprints differ in at most ``DISTANCE`` bits, there is a segment
from which on every chain of l consecutive segments differs in at most l * DISTANCE /
SEGMENTS bits. So two segments in a row are equal, and of the next two one more is, since the
chain of four may differ in one bit. A fingerprint thus has ten keys of three segments each,
and only those that share a key with another are candidates; they can only differ in the
bits that their shared keys leave free.

The full check compares no pairs within a key: a candidate names itself and every word that
one flip of a free bit makes of it. Two fingerprints differ in at most two bits exactly when
they name one word in common, and at most 65 name the same one, however many copies there
are. Each is linked with the smallest of them, whose Hamming distance is counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeprep.llm.components import components
from codeprep.llm.grams import signed
from codeprep.llm.stage import stage

SHINGLE = 3
SEED = 42
DISTANCE = 2
SEGMENTS = 5
BLANK = re.compile(rb"[\x20\x09-\x0D]")
# Words of a text are taken from this many bytes at a time.
BYTES_AT_ONCE = 1 << 18


def word_blocks(text: bytes, size: int = BYTES_AT_ONCE) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size; no word is cut."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            blank = BLANK.search(text, end)
            end = blank.start() if blank else len(text)
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes; no words give 0."""
    ones, n = np.zeros(64, np.int64), 0
    words: list[bytes] = []
    for block in word_blocks(text.lower()):
        words = words[1 - SHINGLE :] + block
        grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.dtype("<u8"))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(text: Column) -> Column:
    """The 64-bit fingerprint of a text as a signed long; null counts as empty."""

    @F.arrow_udf("bigint")
    def measure(texts: pa.Array) -> pa.Array:
        return pa.array([signed(fingerprint(t.as_py() or b"")) for t in texts], pa.int64())

    return measure(text.cast("binary"))


def chain_masks() -> list[int]:
    """The bits of each key: two equal segments in a row and one of the next two."""
    edges = [64 * i // SEGMENTS for i in range(SEGMENTS + 1)]
    bits = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    budget = [length * DISTANCE // SEGMENTS for length in range(SEGMENTS + 1)]
    equal = max(length for length, most in enumerate(budget) if most == 0)
    reach = max(length for length, most in enumerate(budget) if most <= 1)
    masks = []
    for start in range(SEGMENTS):
        chain = [bits[(start + i) % SEGMENTS] for i in range(reach)]
        masks += [sum(chain[:equal]) | more for more in chain[equal:]]
    return masks


def candidates(prints: DataFrame) -> DataFrame:
    """(fp, free) of the distinct fingerprints whose chain key another one has too.

    ``free`` has the bits that some shared key leaves open.
    """
    masks = chain_masks()
    keys = [
        F.struct(F.lit(i).alias("chain"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
        for i, m in enumerate(masks)
    ]
    chains = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")
    shared = chains.groupBy("chain", "key").count().filter("count > 1").select("chain", "key")
    met = chains.join(shared, ["chain", "key"], "left_semi")
    open_bits = F.get(F.array(*[F.lit(~signed(m)) for m in masks]), F.col("chain"))
    return met.groupBy("fp").agg(F.bit_or(open_bits).alias("free"))


def links(prints: DataFrame) -> DataFrame:
    """(u, v): edges between distinct fingerprints that join all within ``DISTANCE`` bits."""
    flips = F.expr(
        "transform(filter(sequence(0, 63), b -> getbit(free, b) = 1), b -> fp ^ shiftleft(1L, b))"
    )
    words = candidates(prints).select(
        "fp", F.explode(F.concat(F.array("fp"), flips)).alias("word")
    )
    # At most 65 fingerprints name a word: itself and those one bit from it.
    near = words.withColumn("hub", F.min("fp").over(Window.partitionBy("word")))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub")))
    near = near.filter((F.col("fp") != F.col("hub")) & (apart <= DISTANCE))
    return near.select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()


def simhash_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    A-Z are lower-cased; words are runs of other than blank and \\x09-\\x0D, and texts are
    taken as bytes, so ones that are no UTF-8 have fingerprints too. Texts of fewer than
    three words are one shingle; null texts and texts without words have fingerprint zero
    and link with each other and with what lies near it. ``component_id`` is the smallest
    id reachable by links. A null id is never the smallest; a group of null ids has a null
    component. Repeated rows stay; an empty table gives an empty result; other columns are
    not looked at.
    """
    rows = stage(docs.select(F.col(ident), fingerprints(F.col(text)).alias("fp")), "fingerprints")
    prints = stage(rows.groupBy("fp").agg(F.min(ident).alias("least")), "distinct-prints")
    groups = components(stage(links(prints), "links"))
    named = prints.join(groups, F.col("fp") == F.col("node"), "left")
    named = stage(
        named.select("fp", "least", F.coalesce("component", "fp").alias("root")), "named"
    )
    least = named.groupBy("root").agg(F.min("least").alias("_least"))
    named = named.join(least, "root").select("fp", "_least")
    return rows.join(named, "fp").select(
        ident,
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("_least").alias("component_id"),
    )

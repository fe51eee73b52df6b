"""SentencePiece encoding by a relational lattice over distinct words, and decoding.

A text is cut into words wherever no piece holds the two characters side by side, so a word
has the same pieces wherever it stands. The distinct words of all texts form the lattice:
every substring as long as some piece that begins like it is a row, an equi-join with the
piece table keeps those that are pieces, the edges are grouped by word, and a fold over the
ends of each word keeps the best path to each. Blocks of documents hold words as places in a list of their own, and get the pieces of
that list back (``block_values``). Tables that no later step reads are removed on the way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from codeprep.llm.block_values import first_block, with_values
from codeprep.llm.memory import releasing
from codeprep.llm.stage import small_batches, stage
from codeprep.staging import remove, scratch_path

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Fixed value: how far below the lowest piece an unknown character scores.
UNKNOWN_PENALTY = 10.0
TABLE_CHARS = 4_000  # characters side by side are looked up in a table of so many squared
LATTICE = 256  # words longer than this are folded one by one, without a lattice table
LATTICE_WORDS = 25_000  # words whose lattice one task holds
PREFIX = 4  # characters by which the sizes of pieces that begin so are looked up
# A word goes to the lattice and back once for each block that has it: large blocks spare most of that.
BLOCK_WORDS = 400_000  # distinct words of a block
BLOCK_CHARS = 4_000_000  # and their characters
BLOCK_SPOTS = 1 << 23  # and words in all, 4 bytes each
DOCS_AT_ONCE = 64  # documents whose words become pieces in one go


@dataclass
class PieceTable:
    """Pieces with their ids and scores; some 32,000 rows, sent along with the tasks."""

    pieces: list[str]
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray  # id of each byte's own piece
    unknown_id: int

    @classmethod
    def read(cls, path: str = MODEL) -> PieceTable:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
        plain = [i for i in range(len(model)) if not any(test(i) for test in special)]
        byte_ids = np.full(256, model.unk_id(), np.int32)
        for i in range(len(model)):
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
        return cls(
            [model.id_to_piece(i) for i in plain],
            np.array(plain, np.int32),
            np.array([model.get_score(i) for i in plain]),
            byte_ids,
            model.unk_id(),
        )

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @property
    def unknown_score(self) -> float:
        return float(self.scores[self.scores > -1e8].min(initial=0.0) - UNKNOWN_PENALTY)

    def word_pattern(self) -> re.Pattern:
        """Words of an escaped text. No piece of the table may cross the end of one."""
        inner = re.compile(rf"[^{SPACE}]{SPACE}|.\n|\n.", re.S)
        stop = re.compile(r"[^\W\d_][.,]")
        if any(inner.search(p) for p in self.pieces):
            return re.compile(r".+", re.S)
        if any(stop.search(p) for p in self.pieces):
            return re.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        return re.compile(rf"{SPACE}*[^\W\d_]++(?=[.,])|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def neighbours(self) -> np.ndarray:
        """Every two characters that stand side by side in some piece, as sorted numbers."""
        found = {ord(a) << 21 | ord(b) for p in self.pieces for a, b in zip(p, p[1:])}
        return np.array(sorted(found), np.int64)


def escaped(text: str) -> str:
    """The text as pieces see it: blanks are marked, and one is put in front."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Cutter:
    """Texts to words."""

    def __init__(self, table: PieceTable):
        self.neighbours = table.neighbours()
        first, second = self.neighbours >> 21, self.neighbours & 0x1FFFFF
        chars = np.unique(np.append(first, second))
        self.number = self.joins = None
        if len(chars) < TABLE_CHARS:  # 0 stands for all other characters
            self.number = np.zeros(0x110000, np.int32)
            self.number[chars] = np.arange(1, len(chars) + 1)
            self.joins = np.zeros((len(chars) + 1, len(chars) + 1), bool)
            self.joins[self.number[first], self.number[second]] = True

    def joined(self, points: np.ndarray) -> np.ndarray:
        """Whether some piece holds a character and the next side by side."""
        if self.joins is not None:
            numbers = self.number[points]
            return self.joins[numbers[:-1], numbers[1:]]
        points = points.astype(np.int64)
        beside = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.neighbours, beside), len(self.neighbours) - 1)
        return self.neighbours[at] == beside

    def words(self, text: str) -> list[str]:
        """The parts of a text between which no piece can lie."""
        text = escaped(text)
        if not text:
            return []
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = (np.flatnonzero(~self.joined(points)) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]


class Spots(dict):
    """Words to places in the order in which they are met, and their characters in all."""

    chars = 0

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.chars += len(word)
        return place


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, packed: first the lowest byte of each, last the highest."""
    planes = numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def opened(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


# A place is a code and as many further bytes as the code asks for: none for the first 192
# places, one for the next 48 * 256 and so on.
CODE_BYTES = np.repeat([0, 1, 2, 4], [192, 48, 15, 1])
CODE_BASES = (np.cumsum(256**CODE_BYTES) - 256**CODE_BYTES).astype(np.int32)
# The first code that asks for a byte more, and how many it then has.
CODE_STEPS = [(192, 1), (240, 2), (255, 4)]


def packed_places(docs: list[np.ndarray]) -> list[bytes]:
    """Each document's places, low ones frequent: codes compressed, then bytes as they are, lowest first."""
    bounds = np.cumsum([0, *map(len, docs)])
    places = np.concatenate(docs)
    codes = (np.searchsorted(CODE_BASES, places, "right") - 1).astype(np.uint8)
    data, packer = codes.tobytes(), zstandard.ZstdCompressor(level=1)
    parts = [[packer.compress(data[a:b]) for a, b in zip(bounds, bounds[1:])]]
    done = 0
    for code, size in CODE_STEPS:
        some = np.flatnonzero(codes >= code)
        rest = places[some] - CODE_BASES[codes[some]]
        ends = np.searchsorted(some, bounds).tolist()
        for k in range(done, size):
            plane = (rest >> 8 * k).astype(np.uint8).tobytes()
            parts.append([plane[a:b] for a, b in zip(ends, ends[1:])])
        done = size
    return [b"".join(of_doc) for of_doc in zip(*parts)]


def opened_places(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of some documents, one after the other, and where those of each begin and end."""
    frames, opener = [], zstandard.ZstdDecompressor()
    for data in packed:
        frame = opener.decompressobj()
        frames.append((frame.decompress(data), frame.unused_data))
    bounds = np.cumsum([0, *(len(codes) for codes, _ in frames)])
    codes = np.frombuffer(b"".join(codes for codes, _ in frames), np.uint8)
    places, at, done = CODE_BASES[codes], [0] * len(frames), 0
    for code, size in CODE_STEPS:
        some = np.flatnonzero(codes >= code)
        counts = np.diff(np.searchsorted(some, bounds)).tolist()
        for k in range(done, size):
            plane = b"".join(rest[a : a + n] for (_, rest), a, n in zip(frames, at, counts))
            places[some] += np.frombuffer(plane, np.uint8).astype(np.int32) << 8 * k
            at = [a + n for a, n in zip(at, counts)]
        done = size
    return places, bounds


class Block:
    """Documents of one block and its distinct words, until it is full."""

    def __init__(self, number: int):
        self.number = number
        self.spots = Spots()
        self.docs: list[np.ndarray] = []
        self.rows: list[pa.Array] = []
        self.prints: list[bytes] = []
        self.size = 0

    def add(self, words: list[str]) -> bool:
        """Take a document's words; true when the block is full."""
        self.docs.append(np.fromiter(map(self.spots.__getitem__, words), np.int32, len(words)))
        self.size += len(words) + 1
        words_full = len(self.spots) >= BLOCK_WORDS or self.spots.chars >= BLOCK_CHARS
        return words_full or self.size >= BLOCK_SPOTS

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Rows of documents, with packed places of their words, and rows of the words.

        Frequent words get low places, which pack well.
        """
        if not self.docs:
            return
        often = np.zeros(len(self.spots), np.int64)
        for at in range(0, len(self.docs), 1_000):
            often += np.bincount(np.concatenate(self.docs[at : at + 1_000]), minlength=len(often))
        order = np.argsort(-often, kind="stable")
        place = np.empty(len(order), "<i4")
        place[order] = np.arange(len(order))
        done = 0
        for rows in self.rows:
            n = len(rows)
            docs = self.docs[done : done + n]
            columns = {
                "kind": pa.array(["docs"] * n),
                "row": rows,
                "block": pa.array([self.number] * n, pa.int64()),
                "words": pa.array(packed_places([place[d] for d in docs]), pa.binary()),
                "print": pa.array(self.prints[done : done + n], pa.binary()),
            }
            done += n
            yield padded(columns, schema)
        words = list(self.spots)
        for at in range(0, len(words), 20_000):
            some = [words[i] for i in order[at : at + 20_000].tolist()]
            columns = {
                "kind": pa.array(["words"]),
                "block": pa.array([self.number], pa.int64()),
                "base": pa.array([at], pa.int32()),
                "list": pa.array([some], pa.list_(pa.string())),
            }
            yield padded(columns, schema)


def padded(columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of ``schema`` whose other columns are null."""
    n = len(next(iter(columns.values())))
    arrays = [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def cut_texts(rows: DataFrame, table: PieceTable, path: str) -> DataFrame:
    """Blocks of (row, body), written to ``path``: rows of documents and lists of words.

    Each ``kind`` of row (docs, words) has a folder of its own. ``print`` is a 128-bit hash of the text's bytes. Bytes that are no UTF-8 become U+FFFD.
    """
    kind = rows.select(
        "row",
        F.lit(0).cast("long").alias("block"),
        F.lit(b"").alias("words"),
        F.lit(b"").alias("print"),
        F.lit(0).alias("base"),
        F.array(F.lit("")).alias("list"),
        F.lit("").alias("kind"),
    ).schema
    for field in kind:
        field.nullable = True
    schema = to_arrow_schema(kind)

    @releasing
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, block = Cutter(table), Block(first_block())
        for batch in batches:
            start = 0
            bodies = batch.column("body")
            for i in range(batch.num_rows):
                body = bodies[i].as_py() or b""
                full = block.add(cutter.words(body.decode("utf-8", "replace")))
                block.prints.append(xxhash.xxh3_128_digest(body))
                if full or i + 1 == batch.num_rows or i + 1 - start == 1_000:
                    block.rows.append(batch.column("row").slice(start, i + 1 - start))
                    start = i + 1
                if full:
                    yield from block.batches(schema)
                    block = Block(block.number + 1)
        yield from block.batches(schema)

    return stage(rows.mapInArrow(scan, kind), "word-blocks", path, folders="kind")


def piece_rows(words: DataFrame, table: PieceTable) -> DataFrame:
    """(piece, id, score): one row per piece, so its size is that of the vocabulary."""
    rows = list(zip(table.pieces, table.ids.tolist(), table.scores.tolist()))
    return words.sparkSession.createDataFrame(rows, "piece string, id int, score double")


def size_rows(words: DataFrame, table: PieceTable) -> DataFrame:
    """(prefix, sizes): the sizes of the pieces that begin so, and all sizes below that.

    Where no piece begins with a prefix, or a word ends before it does, only those below count.
    """
    sizes: dict[str, set[int]] = {}
    for piece in table.pieces:
        if len(piece) >= PREFIX:
            sizes.setdefault(piece[:PREFIX], set(range(1, PREFIX))).add(len(piece))
    rows = [(prefix, sorted(found)) for prefix, found in sizes.items()]
    return words.sparkSession.createDataFrame(rows, "prefix string, sizes array<int>")


# An edge is one number: its end, its size and its piece (0: a character without one).
END, SIZE = 1 << 40, 1 << 32
MASK = SIZE - 1


def edges(words: DataFrame, table: PieceTable) -> DataFrame:
    """(word, edge, score): the substrings of each word that are pieces.

    A character without a piece is an edge too; it stands for its bytes.
    """
    starts = words.select("word", F.explode(F.expr("sequence(1, length(word))")).alias("start"))
    starts = starts.withColumn("prefix", F.expr(f"substring(word, start, {PREFIX})"))
    starts = starts.join(F.broadcast(size_rows(words, table)), "prefix", "left")
    sizes = F.coalesce("sizes", F.array(*[F.lit(i) for i in range(1, PREFIX)]))
    spans = starts.select("word", "start", F.explode(sizes).alias("size"))
    spans = spans.filter("size <= length(word) - start + 1").select(
        "word", "start", "size", F.expr("substring(word, start, size)").alias("piece")
    )
    found = spans.join(F.broadcast(piece_rows(words, table)), "piece", "left")
    found = found.filter("id IS NOT NULL OR size = 1")
    end = (F.col("start") + F.col("size") - 1).cast("long")
    edge = end * END + F.col("size").cast("long") * SIZE + F.coalesce(F.col("id") + 1, F.lit(0))
    return found.select(
        "word", edge.alias("edge"), F.coalesce("score", F.lit(table.unknown_score)).alias("score")
    )


def best_paths(lattice: DataFrame, table: PieceTable) -> DataFrame:
    """(word, ids): the path with the highest sum of scores; of equal ones that whose last
    piece is longer, at every end.

    The fold goes over the edges by end, then size. Entry i of ``best`` is the best path to
    the end i; the best edge to the end at hand joins it when the next end begins.
    """
    grouped = lattice.groupBy("word").agg(
        F.collect_list(F.struct("edge", "score")).alias("edges")
    )
    end = f"cast(e.edge div {END} AS int)"
    size = f"cast({{}}.edge div {SIZE} % {END // SIZE} AS int)"
    score = f"get(s.best, s.end - {size.format('e')}).score + e.score"
    path = f"array_append(get(s.best, s.end - {size.format('s')}).path, s.edge)"
    best = f"""
        aggregate(
          sort_array(edges),
          named_struct(
            'best', array(named_struct('score', 0D, 'path', cast(array() AS array<bigint>))),
            'end', 0, 'score', 0D, 'edge', 0L),
          (s, e) -> if(
            {end} = s.end,
            if({score} >= s.score,
              named_struct('best', s.best, 'end', s.end, 'score', {score}, 'edge', e.edge), s),
            get(transform(
              array(if(s.end = 0, s.best,
                array_append(s.best, named_struct('score', s.score, 'path', {path})))),
              best -> named_struct(
                'best', best, 'end', s.end + 1,
                'score', get(best, s.end + 1 - {size.format('e')}).score + e.score,
                'edge', e.edge)), 0)),
          s -> {path})
    """
    of_byte = F.array(*[F.lit(int(i)) for i in table.byte_ids])

    def bytes_at(edge: Column) -> Column:
        code = F.hex(F.substring("word", F.floor(edge / END).cast("int"), F.lit(1)))
        at = lambda k: F.conv(F.substring(code, 2 * k - 1, F.lit(2)), 16, 10).cast("int")
        return F.transform(
            F.sequence(F.lit(1), (F.length(code) / 2).cast("int")), lambda k: F.get(of_byte, at(k))
        )

    piece = lambda edge: edge.bitwiseAND(F.lit(MASK)).cast("int")
    ids = F.flatten(
        F.transform(
            "path", lambda e: F.when(piece(e) > 0, F.array(piece(e) - 1)).otherwise(bytes_at(e))
        )
    )
    plain = F.transform("path", lambda e: piece(e) - 1)
    found = grouped.select("word", F.expr(best).alias("path"))
    whole = ~F.exists("path", lambda e: piece(e) == 0)
    return found.select("word", F.when(whole, plain).otherwise(ids).alias("ids"))


def folded(words: Column, table: PieceTable) -> Column:
    """The same path for very long words, kept as steps back, one word at a time."""
    known = dict(zip(table.pieces, zip(table.ids.tolist(), table.scores.tolist())))
    longest, unknown, byte_ids = table.longest, table.unknown_score, table.byte_ids.tolist()

    def path(word: str) -> list[int]:
        best, steps = [0.0], [0]
        for end in range(1, len(word) + 1):
            top, step = -np.inf, 1
            for size in range(min(longest, end), 0, -1):
                piece = known.get(word[end - size : end])
                if piece or size == 1:
                    score = best[end - size] + (piece[1] if piece else unknown)
                    if score > top:
                        top, step = score, size
            best.append(top)
            steps.append(step)
        out, end = [], len(word)
        while end:
            piece = word[end - steps[end] : end]
            out.append([known[piece][0]] if piece in known else [byte_ids[b] for b in piece.encode()])
            end -= steps[end]
        return [i for ids in reversed(out) for i in ids]

    @F.arrow_udf("array<int>")
    def fold(batch: pa.Array) -> pa.Array:
        return pa.array([path(w.as_py()) for w in batch], pa.list_(pa.int32()))

    return fold(words)


def word_pieces(words: DataFrame, table: PieceTable) -> DataFrame:
    """(word, ids) of distinct words: by the lattice, very long ones by a fold of their own."""
    short = best_paths(edges(words.filter(F.length("word") <= LATTICE), table), table)
    long = words.filter(F.length("word") > LATTICE)
    return short.unionByName(long.select("word", folded(F.col("word"), table).alias("ids")))


def packed_values(values: DataFrame) -> DataFrame:
    """(block, spot, ids) as few rows per block and task: steps to each place, sizes and ids, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else []
            rows = []
            for a, b in zip(starts, [*starts[1:], len(blocks)]):
                part = batch.slice(a, b - a)
                ids = part.column("ids")
                sizes = ids.value_lengths().to_numpy(zero_copy_only=False)
                steps = np.diff(part.column("spot").to_numpy(zero_copy_only=False), prepend=0)
                rows.append((int(blocks[a]), 0, *map(squeezed, (steps, sizes, ids.flatten().to_numpy()))))
            names = ["block", "spot", "spots", "sizes", "ids"]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    ordered = values.sortWithinPartitions("block", "spot").select("block", "spot", "ids")
    return ordered.mapInArrow(pack, "block bigint, spot int, spots binary, sizes binary, ids binary")


class Pieces:
    """The pieces of a block's words, as one array and where each word's begin."""

    def __init__(self, values: pa.RecordBatch):
        steps, sizes, ids = (
            [opened(v) for v in values.column(c).to_pylist()] for c in ("spots", "sizes", "ids")
        )
        spots, sizes, ids = (
            np.concatenate(c) for c in ([np.cumsum(some) for some in steps], sizes, ids)
        )
        self.sizes = np.zeros(len(spots), np.int64)
        self.sizes[spots] = sizes
        self.starts = np.zeros(len(spots), np.int64)
        self.starts[spots] = np.cumsum(sizes) - sizes
        self.ids = ids

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and where those of each begin and end."""
        sizes = self.sizes[words]
        bounds = np.append(0, np.cumsum(sizes))
        shift = self.starts[words] - bounds[:-1]
        return self.ids[np.repeat(shift, sizes) + np.arange(bounds[-1])], bounds


def encoded_rows(rows: DataFrame, table: PieceTable) -> DataFrame:
    """(row, ids, same) of (row, body): piece ids, and whether decoding gives the text back."""
    spark = rows.sparkSession
    blocks_path, distinct_path, known_path = (
        scratch_path(spark, name) for name in ("word-blocks", "distinct-words", "word-pieces")
    )
    blocks = cut_texts(rows, table, blocks_path)
    words = blocks.filter("kind = 'words'").select(
        "block", "base", F.posexplode("list").alias("at", "word")
    )
    words = words.select("block", (F.col("base") + F.col("at")).alias("spot"), "word")
    distinct = stage(words.select("word").distinct(), "distinct-words", distinct_path)
    # Some thousand words in a task: their lattice is many times as large as they are.
    tasks = distinct.count() // LATTICE_WORDS + 1
    known = stage(word_pieces(distinct.repartition(tasks, "word"), table), "word-pieces", known_path)
    remove(spark, distinct_path)
    values = stage(packed_values(words.join(known, "word").select("block", "spot", "ids")), "values")
    for path in (known_path, f"{blocks_path}/kind=words"):
        remove(spark, path)
    docs = blocks.filter("kind = 'docs'").select("block", "row", "words", "print")
    known_bodies = body_of(table)
    bodies = [known_bodies.get(i, b"\xef\xbf\xbd") for i in range(max(known_bodies, default=0) + 1)]
    mark = SPACE.encode()
    held: list = [None, None]

    def use(values: pa.RecordBatch | None, part: pa.RecordBatch) -> pa.RecordBatch:
        if values is not None and values is not held[0]:
            held[:] = values, Pieces(values)
        found, sizes, same = [np.empty(0, np.int32)], [], []
        for at in range(0, part.num_rows, DOCS_AT_ONCE):
            some = part.slice(at, DOCS_AT_ONCE)
            places, bounds = opened_places(some.column("words").to_pylist())
            if len(places):
                ids, ends = held[1].of(places)
                bounds = ends[bounds]
                found.append(ids)
                ids = ids.tolist()
            for a, b, hashed in zip(bounds, bounds[1:], some.column("print").to_pylist()):
                text = b"".join(map(bodies.__getitem__, ids[a:b])) if a < b else b""
                same.append(xxhash.xxh3_128_digest(text.replace(mark, b" ")[1:]) == hashed)
            sizes += np.diff(bounds).tolist()
        lists = pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(found).astype(np.int32))
        )
        return pa.RecordBatch.from_arrays([part.column("row"), lists, pa.array(same)], ["row", "ids", "same"])

    kind = rows.select("row", F.array(F.lit(0)).alias("ids"), F.lit(True).alias("same")).schema
    small_batches(spark)
    return with_values(docs, values, use, kind)


def body_of(table: PieceTable) -> dict[int, bytes]:
    """The bytes that each id stands for."""
    body = {int(i): p.encode() for i, p in zip(table.ids, table.pieces)}
    return body | {int(i): bytes([b]) for b, i in enumerate(table.byte_ids) if i != table.unknown_id}


def decoded(ids: Column, table: PieceTable) -> Column:
    """The text of piece ids; byte pieces are put together, the leading blank goes.

    Null ids give null; ids outside the table and parts that are no UTF-8 give U+FFFD.
    """
    body = body_of(table)

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows:
            if not row.is_valid:
                out.append(None)
                continue
            values = row.values.to_numpy(zero_copy_only=False).tolist()
            data = b"".join(body.get(i, b"\xef\xbf\xbd") for i in values)
            out.append(data.decode("utf-8", "replace").replace(SPACE, " ")[1:])
        return pa.array(out, pa.string())

    return decode(ids)


def with_pieces(docs: DataFrame, out: str, text: str = "text", path: str = MODEL) -> DataFrame:
    """``docs`` with the piece ids of ``text`` in a new column; every row stays as it is.

    Null and empty texts have no pieces. Bytes that are no UTF-8 count as U+FFFD.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text).cast("binary").alias("body"))
    found = encoded_rows(rows, PieceTable.read(path))
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("ids").alias(out))


def round_trip(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", path: str = MODEL
) -> DataFrame:
    """id, ids, n_pieces and whether decoding gives the text back (null counts as empty).

    It does for every text in UTF-8 without U+2581, which stands for a blank. Repeated rows
    get equal pieces; an empty table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(F.struct(F.col(ident).alias("id")).alias("row"), F.col(text).cast("binary").alias("body"))
    found = encoded_rows(rows, PieceTable.read(path))
    return found.select(
        F.col("row.id").alias(ident),
        "ids",
        F.size("ids").cast("long").alias("n_pieces"),
        F.col("same").alias("round_trip"),
    )

import random

import pytest

# Names that the operators use for columns of their own.
CLASHES = ("_id", "_text", "n", "cls", "key", "a", "b", "tokens", "row", "total", "_s", "slot")
SYLLABLES = "the of an er in on ti ha sh ou re ed nt ble ly ea st wh th or ma lu ke vi po du".split()


def prose(seed: int, n: int) -> str:
    """Text of ``n`` words with sentences and lines, the same for the same seed."""
    draw = random.Random(seed)
    out = []
    for i in range(n):
        word = "".join(draw.choices(SYLLABLES, k=draw.choice([1, 2, 2, 3, 4])))
        out.append(word + (".\n" if i % 13 == 12 else "," if i % 7 == 6 else ""))
    return " ".join(out)


def near_copy(text: str, seed: int, changes: int) -> str:
    draw = random.Random(seed)
    words = text.split()
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10_000)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and long texts, copies, near copies, repeated rows."""
    base, passage = prose(1, 300), prose(2, 60)
    rows = [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, base),
        (5, base),
        (6, near_copy(base, 5, 3)),
        (7, near_copy(base, 6, 60)),
        (8, prose(8, 120) + " " + passage + " " + prose(9, 40)),
        (9, passage + "\n" + prose(10, 90)),
        (10, prose(11, 30_000)),
        (11, "word"),
        (12, "Word"),
        (13, "two  words"),
        (14, "same again " * 200),
        (15, prose(8, 35)),
        (16, "né à l'été 🌊 ▁ 北京 \u0000 end"),
        (16, "né à l'été 🌊 ▁ 北京 \u0000 end"),
        (17, "x" * 5_000),
        (18, "".join(chr(33 + (i * i * 7919) % 90) for i in range(6_000))),
        (19, passage),
    ]
    rows += [(20 + i, near_copy(base, 100 + i, 1 + i % 12)) for i in range(30)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows as a table with further columns, some named like the operators' own."""
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    rows = [(d, t, "en", f"s{d % 3}", 0, *["x"] * len(CLASHES)) for d, t in odd_rows]
    rows.append((None, "an id that is missing", None, None, None, *[None] * len(CLASHES)))
    kind = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}"
    return spark.createDataFrame(rows, kind).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def all_rows(odd_rows):
    return [*odd_rows, (None, "an id that is missing")]

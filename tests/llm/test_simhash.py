import random
from itertools import combinations

import pytest
import xxhash

from codeprep.llm import simhash as S


def slow_print(text):
    words = [w for w in S.BLANK.split((text or "").encode().lower()) if w]
    grams = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows):
    """(doc_id, fingerprint, component) by comparing all pairs."""
    prints = [slow_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)]


def test_equals_brute_force(spark, rows, odd_docs, all_rows):
    found = rows(S.simhash_groups(odd_docs), "doc_id", "fingerprint", "component_id")
    assert found == sorted(slow_groups(all_rows), key=repr)


def test_empty_table(spark, no_docs):
    assert S.simhash_groups(no_docs).count() == 0


def test_texts_in_blocks_are_whole(monkeypatch):
    text = " \n".join(f"Word{i * i % 97}" for i in range(500))
    whole = S.fingerprint(text.encode())
    assert whole == slow_print(text)
    monkeypatch.setattr(S.word_blocks, "__defaults__", (7,))
    assert S.fingerprint(text.encode()) == whole


def test_bytes_that_are_no_utf8(spark):
    docs = spark.sql("SELECT 1L doc_id, CAST(X'61FF62' AS STRING) text")
    expected = f"{xxhash.xxh64_intdigest(bytes.fromhex('61FF62'), 42):016x}"
    assert S.simhash_groups(docs).collect() == [(1, expected, 1)]


@pytest.mark.parametrize("flips", [1, 2, 3])
def test_chains_lose_no_link(spark, flips):
    """Every way to differ in one or two bits is caught, three are left."""
    draw = random.Random(flips)
    pairs = []
    for _ in range(400):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), flips):
            b ^= 1 << bit
        pairs.append((S.signed(a), S.signed(b)))
    prints = spark.createDataFrame([(x,) for p in pairs for x in p], "fp bigint")
    found = {frozenset((r.u, r.v)) for r in S.links(prints).collect()}
    assert found == ({frozenset(p) for p in pairs} if flips <= 2 else set())


def test_large_ball_of_near_prints_is_no_clique(spark):
    """All fingerprints within two bits of one: far fewer edges than pairs, one group."""
    base = 0x0123456789ABCDEF
    ball = [base] + [base ^ (1 << i) for i in range(64)]
    ball += [base ^ (1 << i) ^ (1 << j) for i, j in combinations(range(64), 2)]
    prints = spark.createDataFrame([(S.signed(x),) for x in ball], "fp bigint")
    edges = S.links(prints).cache()
    assert edges.count() < 65 * len(ball)
    groups = S.components(edges)
    assert groups.select("component").distinct().count() == 1
    assert groups.count() == len(ball)

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codeprep.llm import list_ranking as L
from codeprep.llm import prefix_trie as T

KIND = "conv_id bigint, turn bigint, role string, text string, depth string, k1 string, node string"


def slow_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    out = []
    for node, who in members.items():
        ids = ",".join(map(str, sorted(ends[node])))
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who),
            len(children[node]), leaves[node], saved[node], hashlib.sha256(ids.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def conversations(seed, n, hot):
    """Few different turns, so many shared prefixes; one very long conversation; odd values."""
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 11 == 3:
            continue
        for turn in range(draw.randrange(1, 6)):
            rows.append((c, turn, draw.choice(["user", "bot", None]), draw.choice(["a", "é", "", None])))
    rows += [(7, t, "user", f"long {t % 3}") for t in range(10, hot)]
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(200) for t in range(12)]
    rows += [(1, None, "user", "first"), (2, 1, "user", "tie"), (2, 1, "bot", "tie"), (2, 1, "bot", "tie")]
    rows += [(None, 1, "user", "nobody"), (9_000_000_000, 0, None, None), (-7, 0, "x", "below"), (-5, 0, "x", "y")]
    return rows


@pytest.mark.parametrize("depths, ends, most", [(4096, 4096, L.BLOCK), (3, 16, 50)])
def test_equals_brute_force(spark, rows, monkeypatch, depths, ends, most):
    monkeypatch.setattr(T, "DEPTHS", depths)
    monkeypatch.setattr(T, "ENDS", ends)
    given = [r for r in conversations(1, 60, 400) if (r[0] or 0) >= 0]
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in given], KIND).repartition(3)
    found = T.prefix_trie(table, most)
    assert rows(found) == slow_trie(given)


def test_negative_ids_come_in_order(spark, rows):
    given = [(-c, 0, "r", "t") for c in range(1, 40)]
    # The remainder keeps its sign here, so -7 starts as -5 does.
    found = T.prefix_trie(spark.createDataFrame([(*r, "", "", "") for r in given], KIND)).collect()
    root = next(r for r in found if r.depth == 0)
    assert (root.conv_id, root.n_convs) == (-39, 39)
    whole = next(r for r in found if r.depth == 1)
    ended = sorted(
        -c for c in range(1, 40)
        if zlib.crc32(f"-{c}".encode()) % 9 == 0 or (c - c % 5) > 0
    )
    assert whole.ends_sha256 == hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()


def test_empty_table(spark):
    assert T.prefix_trie(spark.createDataFrame([], KIND)).collect() == []


@pytest.mark.parametrize("n, most", [(1, 10), (300, 1000), (3000, 100)])
def test_list_sums(spark, n, most):
    order = list(range(n))
    random.Random(n).shuffle(order)
    rows = [(at, order[i + 1] if i + 1 < n else None, at % 7, 1) for i, at in enumerate(order)]
    table = spark.createDataFrame(rows, "at bigint, next bigint, w bigint, one bigint").cache()
    found = {r.at: (r.before_w, r.before_one) for r in L.sums_before(table, ["w", "one"], most).collect()}
    total, expected = 0, {}
    for i, at in enumerate(order):
        expected[at] = (total, i)
        total += at % 7
    assert found == expected

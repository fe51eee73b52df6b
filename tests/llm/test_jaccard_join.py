import random

import numpy as np
import pytest

from codeprep.llm import jaccard_join as J
from codeprep.llm.components import components

from .conftest import near_copy, prose


def shingle_sets(rows, size):
    out = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        out.append((d, grams if len(w) >= size else {tuple(w)} if w else set()))
    return out


def brute(rows, size, percent):
    """Every pair of rows compared."""
    sets = shingle_sets(rows, size)
    group = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j][1])
            if shared and 100 * shared >= percent * (len(a) + len(sets[j][1]) - shared):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, (d, s) in enumerate(sets):
        ids = [e for k, (e, _) in enumerate(sets) if group[k] == group[i] and e is not None]
        out.append((d, len(s), min(ids) if s and ids else d))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_groups_equal_brute_force(odd_docs, all_rows, size, percent):
    got = J.jaccard_groups(odd_docs, size=size, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(all_rows, size, percent)


def test_chains_of_near_copies(spark):
    """Neighbours in a chain are linked, its ends are not: one component all the same."""
    draw = random.Random(3)
    words = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(60):
        texts.append((i, " ".join(words)))
        words[draw.randrange(150)] = f"c{i}"
    draw.shuffle(texts)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = J.jaccard_groups(docs, size=4, percent=85).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(texts, 4, 85)


@pytest.mark.parametrize("percent", [65, 80, 85, 95, 100])
def test_linked_sets_meet(percent):
    """The keys of two sets at the very edge of the threshold always have one in common."""
    draw = np.random.default_rng(percent)
    classes = J.SizeClasses(percent)
    for _ in range(400):
        union = int(draw.integers(1, 120))
        shared = -(-percent * union // 100)
        left = int(draw.integers(0, union - shared + 1))
        grams = draw.integers(0, 1 << 63, union).astype(np.uint64) * np.uint64(2)
        grams = np.unique(grams)
        if len(grams) < union:
            continue
        draw.shuffle(grams)
        a = np.sort(grams[: shared + left])
        b = np.sort(np.r_[grams[:shared], grams[shared + left :]])
        if len(a) and len(b) and not np.array_equal(a, b):
            keys = J.meeting_keys(a, classes), J.meeting_keys(b, classes)
            assert np.intersect1d(*keys).size


def test_a_common_passage_brings_no_pairs_together(spark):
    """What many copies of a hub have in common comes last among the differences of each."""
    common = np.arange(1, 31, dtype=np.uint64)
    rows = []
    for i in range(20):
        own = np.arange(30, dtype=np.uint64) + np.uint64(1000 * (i + 1))
        rows.append((1, 10 + i, 100, False, [(bytearray(np.r_[own, common].tobytes()), bytearray())]))
    kind = "hub long, cls long, n long, linked boolean, parts array<struct<added:binary,gone:binary>>"
    found = J.first_differences(spark.createDataFrame(rows, kind), 80)
    assert found.filter("gram <= 30").count() == 0
    assert found.groupBy("cls").count().filter("count = 26").count() == 20


def test_texts_of_classes_are_those_packed_with_the_sets(spark):
    """The texts that are compared come from the written sets; no text is cut into n-grams for it."""
    docs = spark.createDataFrame([("a b c d e",), ("A b c d e",), ("x",), (None,)], "text string")
    rows = docs.select(J.sets(docs["text"], 4).alias("s")).select("s.*").persist()
    assert {J.unpacked(r.body) for r in rows.collect()} == {b"a b c d e", b"A b c d e", b"x", b""}
    wanted = rows.filter("n = 2").select("cls").distinct()
    (found,) = J.class_texts(rows, wanted).collect()
    assert found.cls == wanted.first().cls and J.unpacked(found.body).lower() == b"a b c d e"
    rows.unpersist()


def test_one_of_each(odd_docs, no_docs, all_rows):
    kept = J.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    wanted = {c for _, _, c in brute(all_rows, 5, 80)}
    assert sorted(map(repr, ids)) == sorted(map(repr, wanted))
    assert J.one_of_each(no_docs).count() == 0
    assert J.jaccard_groups(no_docs).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 9), (10, 11), (30, 20), (20, 30), (7, 7)]
    edges += [(100 + i, 101 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 50)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert all(got[n] == 1 for n in (1, 2, 3, 9)) and got[11] == 10 and got[30] == 20
    assert {got[100 + i] for i in range(41)} == {100} and {got[500 + i] for i in range(50)} == {500}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_percent_has_a_range(odd_docs):
    with pytest.raises(ValueError):
        J.jaccard_groups(odd_docs, percent=50)


def test_copies_in_every_task(spark):
    """Near copies of which each task has exact copies, in differing order, keep a key."""
    n_groups = 12
    groups = [[prose(1_000 + g, 120)] * 2 for g in range(n_groups)]
    groups = [[a, near_copy(b, g, 1)] for g, (a, b) in enumerate(groups)]
    rows = [(t,) for part in range(4) for g in groups for t in (g if part % 2 else g[::-1])]
    settings = {
        "spark.sql.shuffle.partitions": "211",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        docs = spark.sparkContext.parallelize(rows, 4).toDF("text string")
        lists = J.meetings(docs, "text", 5, 80).persist()
        met = [tuple(r) for r in lists.collect()]
        kept = J.different_lists(lists).collect()
        lists.unpersist()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(met) == len(set(met))
    members = {}
    for r in kept:
        members.setdefault(r["key"], set()).add(r["cls"])
    hashes = J.WordHashes()
    for texts in groups:
        pair = {J.set_class(J.shingles(t.encode(), 5, hashes)) for t in texts}
        assert len(pair) == 2 and any(pair <= found for found in members.values())

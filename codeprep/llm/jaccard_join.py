"""Documents linked by the Jaccard similarity of their word n-grams, and their groups.

The n-grams of all documents have one order, that of their hashes. It is cut into fragments
(vertical partitions), many for large sets. Two sets that are similar enough differ in few
n-grams, so among the largest fragments of each one is the same in both: documents meet on
the content of a whole fragment, not on single n-grams. Pairs that meet are then counted:
the order is cut into a few fragments, each counts its part of the overlap by itself, and
the parts are summed per pair. That decides, by whole numbers.

Groups of near copies are not expanded into pairs. Where few documents meet, all of them are
compared. Where many do, each is compared with one of them, the hub. Two documents that are
both linked with their hub need no comparison. Of the others, say x and y, the differences
from the hub tell how far x and y are apart (their difference is the difference of these
two), so x and y can only be linked if those share so many n-grams that the first few of
each, in one order, have one in common. Such pairs are compared too. Every link between
different texts is thus counted, or follows from others.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeprep.llm.components import components
from codeprep.llm.grams import STEP, WordHashes, mix, packed, sequence_hash, unpacked, windows
from codeprep.llm.memory import releasing
from codeprep.llm.repeats import Flusher, repeated, schema
from codeprep.llm.stage import free_name, stage

GROWTH = 1.6  # sizes of one class of set sizes differ by this factor at most
COUNTED_FRAGMENTS = 4
FRAGMENT_BITS = 2
PAIRS_PER_TASK = 500
REMEMBERED_CLASSES = 100_000  # a class met again after so many others is only given out twice
FEW = 8  # documents that meet on a key and are all compared with each other


def shingles(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Distinct n-gram hashes in order; a shorter text is one n-gram, no words are none."""
    ids = hashes.of(text.lower().split())
    found = windows(ids, min(size, max(len(ids), 1)))
    if 0 < len(ids) < size:  # never equal to an n-gram of the full length
        found = mix(found ^ mix(np.array([len(ids)], np.uint64)))
    return np.unique(found)


def set_class(grams: np.ndarray) -> int:
    return sequence_hash(grams, kind=len(grams))


class SizeClasses:
    """Classes of set sizes, and how many fragments the order has for each."""

    def __init__(self, percent: int):
        self.percent = percent
        self.known: dict[int, int] = {}
        self.tops = [2]

    def top(self, n: int) -> int:
        """The first size above the class of ``n``."""
        while self.tops[-1] <= n:
            low = self.tops[-1]
            self.tops.append(max(low + 1, math.ceil(low * GROWTH)))
        return self.tops[bisect_right(self.tops, n)]

    def fragments(self, top: int) -> int:
        """The number of fragments for sets of fewer than ``top`` n-grams.

        Two linked sets differ in at most a share r of the smaller. The fragments are so
        many that the expected number with n-grams in them is a tenth above that.
        """
        if top not in self.known:
            ratio = (100 - self.percent) / self.percent
            low, high = 1e-3, 60.0  # n-grams per fragment; fewer leave more fragments filled
            for _ in range(60):
                middle = (low + high) / 2
                if -math.expm1(-middle) / middle > 1.1 * ratio:
                    low = middle
                else:
                    high = middle
            few = int((top - 1) * ratio) == 0
            self.known[top] = 1 if few else max(1, math.ceil(top / low))
        return self.known[top]


def meeting_keys(grams: np.ndarray, classes: SizeClasses) -> np.ndarray:
    """Keys of which any two linked, unequal sets share at least one.

    Linked sets differ in at most k = (100 - percent) * n // percent n-grams, n being
    either size. Each set takes its k + 1 first fragments with n-grams in them, largest
    first, then by hash: one order for all sets, so the set whose last one comes first has
    a fragment untouched by the difference, and the other set has taken it too. A set with
    too few such fragments takes all, and its k + 1 first n-grams for those like it. Sets
    just below the next size class take the keys of that class as well.
    """
    n, percent = len(grams), classes.percent
    need = (100 - percent) * n // percent + 1
    tops = [classes.top(n)]
    if 100 * n >= percent * tops[0]:
        tops.append(classes.top(tops[0]))
    found = []
    for top in tops:
        count = np.uint64(classes.fragments(top))
        fragment = ((grams >> np.uint64(32)) * count) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, fragment[1:] != fragment[:-1]])
        sums = np.add.reduceat(mix(grams ^ STEP), starts)
        place = mix(np.array([top], np.uint64))
        keys = mix(mix(sums + fragment[starts] * STEP) ^ place)
        if len(keys) >= need:
            sizes = np.diff(np.append(starts, n))
            keys = keys[np.lexsort((keys, -sizes))[:need]]
        else:
            keys = np.r_[keys, mix(mix(grams[:need]) + place)]
        found.append(keys)
    return np.unique(np.concatenate(found))


def sets(text: Column, size: int) -> Column:
    """struct(n, cls, body): the number of n-grams, a number for sets that are equal, and the
    packed text."""

    def measure_batch(texts: pa.Array, hashes: WordHashes) -> pa.Array:
        bodies = [t.as_py() or b"" for t in texts]
        found = [shingles(body, size, hashes) for body in bodies]
        return pa.StructArray.from_arrays(
            [
                pa.array([len(g) for g in found], pa.int64()),
                pa.array([set_class(g) for g in found], pa.int64()),
                pa.array([packed(body) for body in bodies], pa.binary()),
            ],
            ["n", "cls", "body"],
        )

    @F.arrow_udf("struct<n:bigint,cls:bigint,body:binary>")
    @releasing
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for texts in batches:
            yield measure_batch(texts, hashes)

    return measure(text.cast("binary"))


def meetings(docs: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """(key, cls, n), each once, of the keys on which sets of two classes or more meet.

    A class with copies in several tasks may be first for a key in one and not in another,
    and then ``repeated`` gives it out from two partitions.
    """

    @releasing
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, out, seen = WordHashes(), Flusher(), set()
        classes = SizeClasses(percent)
        for batch in batches:
            for t in batch.column(0):
                grams = shingles(t.as_py() or b"", size, hashes)
                cls = set_class(grams)
                if not len(grams) or cls in seen:
                    continue
                seen.add(cls)
                keys = meeting_keys(grams, classes)
                full = out.add(
                    keys.view(np.int64), np.full(len(keys), cls), np.full(len(keys), len(grams))
                )
                if full:
                    yield from out.flush()
                    seen.clear()
        yield from out.flush()

    rows = docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(scan, schema())
    met = repeated(rows).select("key", F.col("a").alias("cls"), F.col("b").alias("n"))
    return met.distinct()


def different_lists(lists: DataFrame) -> DataFrame:
    """One of the keys on which the same classes meet; near copies share very many."""
    members = lists.groupBy("key").agg(
        F.bit_xor(F.xxhash64("cls")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("y"),
    )
    kept = members.groupBy("x", "y").agg(F.min("key").alias("key")).select("key")
    return lists.join(kept, "key", "left_semi")


def class_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, body): the packed text of each wanted class once. ``rows`` has both of each document."""

    @releasing
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            if len(seen) > REMEMBERED_CLASSES:
                seen.clear()
            new = []
            for i, cls in enumerate(batch.column("cls").to_pylist()):
                if cls not in seen:
                    seen.add(cls)
                    new.append(i)
            yield batch.take(pa.array(new, pa.int64()))

    rows = rows.select("cls", "body").mapInArrow(scan, "cls bigint, body binary")
    return rows.join(wanted, "cls").groupBy("cls").agg(F.first("body").alias("body"))


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """For every pair (hub, cls, star): both sizes, the n-grams shared, whether linked.

    Overlaps are counted per fragment and summed. With ``star`` the pair also gets
    ``parts``: per fragment the n-grams that only cls and only the hub has. The pairs of a
    hub are dealt over as many tasks as their number asks for, and its n-grams go to each;
    a task holds those of one hub and one fragment at a time.
    """
    lots = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PAIRS_PER_TASK).alias("_lots"))
    salt = F.pmod(F.xxhash64("cls"), F.col("_lots")).alias("salt")
    members = pairs.join(lots, "hub").select("hub", salt, F.lit(1).alias("rank"), "cls", "star")
    members = members.join(texts, "cls").select("hub", "salt", "rank", "cls", "star", "body")
    hubs = lots.join(texts.withColumnRenamed("cls", "hub"), "hub").select(
        "hub",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lots") - 1)).alias("salt"),
        F.lit(0).alias("rank"),
        F.col("hub").alias("cls"),
        F.lit(False).alias("star"),
        "body",
    )
    names = ["hub", "salt", "rank", "cls", "star", "fragment", "n", "grams"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int64()]
    kinds.append(pa.binary())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, names)

    @releasing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows, held = [], 0
            for hub, salt_, rank, cls, star, body in zip(*(c.to_pylist() for c in batch.columns)):
                grams = shingles(unpacked(body), size, hashes)
                parts = grams >> np.uint64(64 - FRAGMENT_BITS)
                bounds = np.searchsorted(parts, np.arange(COUNTED_FRAGMENTS + 1))
                for f, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    data = grams[a:b].tobytes()
                    rows.append((hub, salt_, rank, cls, star, f, len(grams), data))
                held += 8 * len(grams)
                if held > 8_000_000:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ["hub", "cls", "n_hub", "n", "shared"]
        hub_grams, hub_n = np.empty(0, np.uint64), 0
        for batch in batches:
            rows, parts = [], []
            columns = (batch.column(c).to_pylist() for c in ("hub", "rank", "cls", "star", "n", "grams"))
            for hub, rank, cls, star, n, grams in zip(*columns):
                some = np.frombuffer(grams, np.uint64)
                if rank == 0:
                    hub_grams, hub_n = some, n
                    continue
                at = np.searchsorted(hub_grams, some)
                both = at < len(hub_grams)
                both[both] = hub_grams[at[both]] == some[both]
                rows.append((hub, cls, hub_n, n, int(both.sum())))
                gone = np.ones(len(hub_grams), bool)
                gone[at[both]] = False
                parts.append(
                    {"added": some[~both].tobytes(), "gone": hub_grams[gone].tobytes()}
                    if star
                    else None
                )
            columns = [pa.array(c, pa.int64()) for c in list(zip(*rows)) or [()] * 5]
            kind = pa.struct([("added", pa.binary()), ("gone", pa.binary())])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, kind)], [*out, "part"])

    kind = "hub bigint, salt bigint, rank int, cls bigint, star boolean, fragment int, n bigint, grams binary"
    parts = members.unionByName(hubs).mapInArrow(cut, kind)
    dealt = parts.repartition("hub", "salt", "fragment")
    dealt = dealt.sortWithinPartitions("hub", "salt", "fragment", "rank")
    kind = (
        "hub bigint, cls bigint, n_hub bigint, n bigint, shared bigint, "
        "part struct<added:binary,gone:binary>"
    )
    partial = dealt.mapInArrow(count, kind)
    sums = partial.groupBy("hub", "cls").agg(
        F.sum("shared").alias("shared"),
        F.max("n_hub").alias("n_hub"),
        F.max("n").alias("n"),
        F.collect_list("part").alias("parts"),
    )
    union = F.col("n_hub") + F.col("n") - F.col("shared")
    return sums.withColumn("linked", 100 * F.col("shared") >= percent * union)


def first_differences(stars: DataFrame, percent: int) -> DataFrame:
    """(hub, gram, at, cls, n, d, linked): the first n-grams in which each document differs.

    ``d`` is how many there are in all, ``at`` the place of this one, from 0. In each hub's
    order come those in which the fewest documents differ, then by hash: a passage that many
    copies have in common, or lack, comes last and brings few of them together. With t percent, two documents x and
    y of a hub that are linked differ in at most K = (100 - t) * (n_x + n_y) / (100 + t)
    n-grams, so their differences from the hub share s >= (d_x + d_y - K) / 2. If x is not
    linked with the hub, d_x is over the same bound for x and the hub, and from that follows
    s > d_y * t / (100 + t). Also d_y >= d_x - K, so s >= d_x - K, and K is at most
    (100 - t) * n_x / t. A document takes as many n-grams as leave fewer than that s out.
    """

    @releasing
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, repeat = [], []
            for parts, n, linked in zip(
                *(batch.column(c).to_pylist() for c in ("parts", "n", "linked"))
            ):
                grams = np.frombuffer(b"".join(p["added"] + p["gone"] for p in parts), np.int64)
                d = len(grams)
                if linked:
                    least = d * percent // (100 + percent) + 1
                else:
                    least = max(1, d - (100 - percent) * n // percent)
                found.append(grams if least <= d else grams[:0])
                repeat.append((d, d - least + 1))
            taken = np.array([len(f) for f in found], np.int64)
            rows = np.repeat(np.arange(len(found)), taken)
            base = {c: batch.column(c).take(pa.array(rows)) for c in ("hub", "cls", "n", "linked")}
            grams = np.concatenate(found) if found else np.empty(0, np.int64)
            d, first = np.repeat(np.array(repeat, np.int64).reshape(-1, 2), taken, axis=0).T
            yield pa.RecordBatch.from_arrays(
                [base["hub"], pa.array(grams), base["cls"], base["n"], pa.array(d), pa.array(first),
                 base["linked"]],
                ["hub", "gram", "cls", "n", "d", "first", "linked"],
            )

    kind = "hub bigint, gram bigint, cls bigint, n bigint, d bigint, first bigint, linked boolean"
    every = stage(stars.select("hub", "cls", "n", "linked", "parts").mapInArrow(scan, kind), "all-differences")
    often = every.groupBy("hub", "gram").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("hub", "cls").orderBy("often", "gram")
    placed = every.join(often, ["hub", "gram"]).withColumn("at", F.row_number().over(order).cast("long") - 1)
    return placed.filter("at < first").select("hub", "gram", "at", "cls", "n", "d", "linked")


def compatible(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be linked at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` (node, component) after further links; only components are linked anew."""
    u = groups.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    v = groups.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    known = links.join(u, "u", "left").join(v, "v", "left")
    over = known.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    over = components(stage(over.distinct(), "over"))
    over = over.withColumnRenamed("component", "_to").withColumnRenamed("node", "_from")
    moved = groups.join(over, F.col("component") == F.col("_from"), "left")
    moved = moved.select("node", F.coalesce("_to", "component").alias("component"))
    alone = over.join(groups, F.col("_from") == F.col("node"), "left_anti")
    return stage(
        moved.union(alone.select(F.col("_from").alias("node"), F.col("_to"))), "groups"
    )


def first_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(hub, cls, star): all pairs of short lists, and of long ones each member with the hub.

    The hub of a long list is the member that meets the most others: of many near copies
    that is the one they are copies of, or one close to it.
    """
    sizes = lists.groupBy("key").agg(F.count("*").alias("size"))
    sized = stage(lists.join(sizes, "key"), "sized")
    short = sized.filter(F.col("size") <= FEW)
    other = short.select("key", F.col("cls").alias("hub"), F.col("n").alias("hub_n"))
    close = short.join(other, "key").filter("hub < cls")
    close = close.filter(compatible(F.col("n"), F.col("hub_n"), percent))
    long = sized.filter(F.col("size") > FEW)
    degrees = long.groupBy("cls").agg(F.sum("size").alias("degree"))
    known = long.join(degrees, "cls").groupBy("key")
    hubs = known.agg(F.max(F.struct("degree", "cls"))["cls"].alias("hub"))
    stars = long.join(hubs, "key").filter("hub <> cls").select("hub", "cls", F.lit(True).alias("star"))
    every = close.select("hub", "cls", F.lit(False).alias("star")).union(stars)
    return every.groupBy("hub", "cls").agg(F.max("star").alias("star"))


def further_pairs(
    checked: DataFrame, groups: DataFrame, percent: int
) -> DataFrame:
    """(hub, cls, star): pairs of different components that may be linked past their hub.

    Two documents that share several hubs are looked at under one of them, that with most
    documents.
    """
    stars = checked.filter(F.size("parts") > 0)
    weights = stars.groupBy("hub").agg(F.count("*").alias("w"))
    hubs = stars.select("hub", "cls").join(weights, "hub")
    hubs = hubs.groupBy("cls").agg(F.collect_list(F.struct("w", "hub")).alias("hubs"))
    open_ = stars.filter(~F.col("linked")).select("hub").distinct()
    rows = first_differences(stars.join(open_, "hub", "left_semi"), percent)
    rows = rows.join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    rows = rows.withColumn("comp", F.coalesce("component", "cls")).drop("component")
    rows = stage(rows.join(weights, "hub").join(hubs, "cls"), "differences")
    apart = rows.filter(~F.col("linked")).select(
        "hub", "gram", *[F.col(c).alias(f"x_{c}") for c in ("at", "cls", "n", "d", "comp", "hubs")]
    )
    shared_hub = F.array_max(F.array_intersect("hubs", "x_hubs"))
    # No more than what lies behind the first n-gram in common can be shared.
    furthest = (100 - percent) * (F.col("n") + F.col("x_n"))
    behind = F.least(F.col("d") - F.col("at"), F.col("x_d") - F.col("x_at"))
    enough = (F.col("d") + F.col("x_d") - 2 * behind) * (100 + percent) <= furthest
    found = apart.join(
        rows.withColumnsRenamed({"hub": "y_hub", "gram": "y_gram"}),
        (F.col("hub") == F.col("y_hub"))
        & (F.col("gram") == F.col("y_gram"))
        & (F.col("comp") != F.col("x_comp"))
        & (F.col("linked") | (F.col("cls") < F.col("x_cls")))
        & (F.abs(F.col("d") - F.col("x_d")) * (100 + percent) <= furthest)
        & enough
        & (shared_hub == F.struct("w", F.col("y_hub").alias("hub")))
        & compatible(F.col("n"), F.col("x_n"), percent),
    )
    pairs = found.select(
        F.least("cls", "x_cls").alias("hub"), F.greatest("cls", "x_cls").alias("cls")
    ).distinct()
    before = checked.select(F.least("hub", "cls").alias("hub"), F.greatest("hub", "cls").alias("cls"))
    return pairs.join(before, ["hub", "cls"], "left_anti").withColumn("star", F.lit(False))


def class_components(
    docs: DataFrame, rows: DataFrame, text: str, size: int, percent: int
) -> DataFrame:
    """(node, component) of the set classes that are linked with another.

    ``rows`` is the written table of the documents' classes and packed texts.
    """
    lists = stage(meetings(docs, text, size, percent), "meetings")
    lists = stage(different_lists(lists), "lists")
    texts = stage(class_texts(rows, lists.select("cls").distinct()), "class-texts")

    def links(rows: DataFrame) -> DataFrame:
        return rows.filter("linked").select(F.col("hub").alias("u"), F.col("cls").alias("v"))

    pairs = stage(first_pairs(lists, percent), "pairs")
    checked = stage(verified(pairs, texts, size, percent), "verified")
    groups = components(links(checked))
    pairs = stage(further_pairs(checked, groups, percent), "further-pairs")
    checked = stage(verified(pairs, texts, size, percent), "verified")
    return merged(groups, links(checked))


def jaccard_groups(
    docs: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    size: int = 5,
    percent: int = 80,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest linked id).

    A-Z are lower-cased; words are runs of other than blank and \\x09-\\x0D. Two rows are
    linked when 100 * intersection >= ``percent`` * union of their n-gram sets. Rows with
    equal sets (copies, repeated rows) are one class and are never paired. Null texts and
    texts without words have no n-grams and stand alone, with their own id. A null id is
    never the smallest; a group of null ids has a null component. An empty table gives an
    empty result; other columns are not looked at.
    """
    if not 65 <= percent <= 100:
        raise ValueError("percent must lie between 65 and 100")
    rows = docs.select(F.col(ident), sets(F.col(text), size).alias("_s"))
    rows = stage(rows.select(ident, "_s.*"), "sets")
    groups = class_components(docs, rows, text, size, percent)
    groups = groups.select(F.col("node").alias("cls"), "component")
    tagged = rows.join(groups, "cls", "left").withColumn("comp", F.coalesce("component", "cls"))
    tagged = stage(tagged.select(ident, "n", "comp"), "tagged")
    least = tagged.filter("n > 0").groupBy("comp").agg(F.min(ident).alias("_least"))
    return tagged.join(least, "comp", "left").select(
        ident,
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col(ident)).alias("component_id"),
    )


def one_of_each(docs: DataFrame, ident: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay when one of each group does: that with the smallest id.

    Rows with a null id have no place in the order and all stay. Of rows that repeat the
    id of a group one stays.
    """
    groups = stage(jaccard_groups(docs, ident, text, **options), "groups")
    name = free_name("_keep", docs.columns)
    kept = groups.filter(F.col(ident) == F.col("component_id")).select(F.col(ident).alias(name))
    again = kept.groupBy(name).count().filter("count > 1").select(name)
    stay = docs.join(kept.distinct(), F.col(ident) == F.col(name), "left_semi")
    if not again.isEmpty():
        twice = stay.join(again, F.col(ident) == F.col(name), "left_semi").dropDuplicates([ident])
        once = stay.join(again, F.col(ident) == F.col(name), "left_anti")
        stay = once.unionByName(twice)
    return stay.unionByName(docs.filter(F.col(ident).isNull()))

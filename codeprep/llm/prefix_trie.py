"""The trie of conversation prefixes, its subtrees summed over an Euler tour.

Every distinct sequence of first turns is a node. A node is known by its depth and 128 bits
of hash over its turns, which are built up in blocks of depths, so that a very long
conversation is no task of its own. Nodes get dense numbers in the order (smallest member,
depth). Each node has an arc that enters it and one that leaves it; entering leads on to the
first child, leaving to the next sibling or out of the parent. The tour is one linked list;
``list_ranking`` sums leaves and savings along it, and what a subtree holds is the difference
between the sums where its node is left and entered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeprep.llm.list_ranking import BLOCK, sums_before
from codeprep.llm.stage import stage
from codeprep.operators.numbering import number_sorted, number_within

SHARED_EVERY = 5  # conversation c starts as conversation c - c % 5 does
SHARED_MOST = 9  # with the first crc32(c) % 9 turns of it
DEPTHS = 4_096  # depths whose hashes are built up in one task
ENDS = 4_096  # ids of members that are put together in one string
KEY = ["depth", "k1", "k2"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, turn_hash, n_bytes): the turns in order, from 1, without their texts.

    Turns of equal number come in order of the md5 of role and text.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        "turn",
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("turn_hash"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    return number_within(turns, ["turn", "turn_hash"], "rank", ["conv_id"]).drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, turn_hash, n_bytes) of the rebuilt turns, and (conv_id, n_turns).

    Of the conversation that lends its start at most eight turns are copied, to five others.
    """
    lengths = turns.groupBy("conv_id").agg(F.max("rank").alias("n"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_MOST
    convs = lengths.select(
        "conv_id", "n", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % SHARED_EVERY).alias("base")
    )
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").select(
        "conv_id", "base", "n", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("lent")
    )
    convs = stage(convs, "conversations")
    start = turns.filter(
        (F.col("rank") < SHARED_MOST) & (F.col("conv_id") % SHARED_EVERY == 0)
    ).select(F.col("conv_id").alias("base"), F.col("rank").alias("depth"), "turn_hash", "n_bytes")
    first = convs.join(start, "base").filter("depth <= lent")
    own = turns.join(convs.select("conv_id", "h", "lent"), "conv_id").filter("rank > h")
    own = own.withColumn("depth", F.col("lent") + F.col("rank") - F.col("h"))
    columns = ["conv_id", "depth", "turn_hash", "n_bytes"]
    n_turns = (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")
    return first.select(columns).unionByName(own.select(columns)), convs.select("conv_id", n_turns)


def prefixes(turns: DataFrame) -> DataFrame:
    """Each rebuilt turn with the hashes (k1, k2) of the turns up to it, and (p1, p2) before it.

    A prefix is hashed as the exclusive or of hashes of (depth, turn), which can be put
    together in blocks of depths: within each, and over the blocks of a conversation.
    """
    each = turns.select(
        "conv_id",
        "depth",
        "n_bytes",
        F.expr(f"depth div {DEPTHS}").alias("_block"),
        *[F.xxhash64(F.lit(i), "depth", "turn_hash").alias(f"t{i}") for i in (1, 2)],
    )
    each = stage(each, "turn-hashes")
    parts = each.groupBy("conv_id", "_block").agg(*[F.bit_xor(f"t{i}").alias(f"s{i}") for i in (1, 2)])
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    parts = parts.select(
        "conv_id",
        "_block",
        *[F.coalesce(F.bit_xor(f"s{i}").over(earlier), none).alias(f"c{i}") for i in (1, 2)],
    )
    inside = Window.partitionBy("conv_id", "_block").orderBy("depth")
    each = each.select("*", *[F.bit_xor(f"t{i}").over(inside).alias(f"i{i}") for i in (1, 2)])
    joined = each.join(parts, ["conv_id", "_block"])
    whole = [F.col(f"i{i}").bitwiseXOR(F.col(f"c{i}")) for i in (1, 2)]
    return joined.select(
        "conv_id",
        "depth",
        "n_bytes",
        *[k.alias(f"k{i}") for i, k in enumerate(whole, 1)],
        *[k.bitwiseXOR(F.col(f"t{i}")).alias(f"p{i}") for i, k in enumerate(whole, 1)],
    )


def member_hashes(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which conversations end.

    Ids are joined to strings by ranges of ids; one node's strings then stream through one
    hash, which holds nothing but its state.
    """
    bucket = F.expr(f"conv_id div {ENDS}")
    strings = ends.groupBy(*KEY, bucket.alias("bucket")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids")
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            rows = [{**dict(zip(KEY, key)), "ends_sha256": digest} for key, digest in done]
            return pa.RecordBatch.from_pylist(rows, kind)

        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in [*KEY, "ids"])):
                if key == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
            yield batch_of(done)
        if now is not None:
            yield batch_of([(now, state.hexdigest())])

    kind = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    dealt = strings.repartition(*KEY).sortWithinPartitions(*KEY, "bucket").select(*KEY, "ids")
    return dealt.mapInArrow(stream, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """(node, depth, k1, k2, p1, p2, conv_id, n_convs, n_bytes, ends_sha256), numbered from 0."""
    turns, lengths = rebuilt(stage(numbered_turns(conversations), "turns"))
    found = stage(prefixes(turns), "prefixes")
    zero = F.lit(0).cast("long")
    nodes = found.groupBy(*KEY, "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes")
    )
    roots = lengths.groupBy(*[zero.alias(c) for c in KEY], zero.alias("p1"), zero.alias("p2")).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), zero.alias("n_bytes")
    )
    last = lengths.filter("n_turns > 0").withColumnRenamed("n_turns", "depth")
    ends = found.join(last, ["conv_id", "depth"]).select("conv_id", *KEY)
    ends = ends.unionByName(
        lengths.filter("n_turns = 0").select("conv_id", *[zero.alias(c) for c in KEY])
    )
    nodes = number_sorted(nodes.unionByName(roots), ["conv_id", "depth"], "node", start=0)
    nodes = nodes.join(member_hashes(ends), KEY, "left")
    return stage(nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))), "nodes")


def euler_tour(family: DataFrame) -> DataFrame:
    """The arcs (at, next, leaves, saved) of nodes (node, parent, first_child, sibling, saved).

    Node v is entered by arc 2v and left by arc 2v + 1.
    """
    leaf = F.col("first_child").isNull()
    enter = F.struct(
        (2 * F.col("node")).alias("at"),
        F.coalesce(2 * F.col("first_child"), 2 * F.col("node") + 1).alias("next"),
        leaf.cast("long").alias("leaves"),
        F.col("saved").alias("saved"),
    )
    leave = F.struct(
        (2 * F.col("node") + 1).alias("at"),
        F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1).alias("next"),
        F.lit(0).cast("long").alias("leaves"),
        F.lit(0).cast("long").alias("saved"),
    )
    return family.select(F.explode(F.array(enter, leave)).alias("a")).select("a.*")


def siblings(children: DataFrame) -> DataFrame:
    """(node, sibling): the next node with the same parent, from one order of all children."""
    spots = stage(number_sorted(children, ["parent", "node"], "spot"), "spots")
    after = spots.select(
        (F.col("spot") - 1).alias("spot"), F.col("parent").alias("_p"), F.col("node").alias("sibling")
    )
    return spots.join(after, "spot").filter("parent = _p").select("node", "sibling")


def subtree_sums(nodes: DataFrame, most: int = BLOCK) -> DataFrame:
    """(node, parent, parent_conv_id, n_children, n_leaves, saved_tokens) of every node.

    ``most`` is how many arcs of the tour one task may hold.
    """
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"),
        F.col("k1").alias("p1"),
        F.col("k2").alias("p2"),
        F.col("node").alias("parent"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    children = nodes.filter("depth > 0").join(above, ["depth", "p1", "p2"])
    children = stage(children.select("node", "parent", "parent_conv_id"), "children")
    firsts = children.groupBy("parent").agg(
        F.min("node").alias("first_child"), F.count(F.lit(1)).alias("n_children")
    )
    family = nodes.select("node", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    family = family.join(children, "node", "left").join(
        siblings(children.select("node", "parent")), "node", "left"
    )
    family = family.join(firsts.withColumnRenamed("parent", "node"), "node", "left")
    family = stage(family, "family")
    sums = sums_before(stage(euler_tour(family), "tour"), ["leaves", "saved"], most)
    sign = F.when(F.col("at") % 2 == 1, 1).otherwise(-1).cast("long")
    inside = sums.groupBy(F.expr("`at` div 2").alias("node")).agg(
        F.sum(sign * F.col("before_leaves")).alias("n_leaves"),
        F.sum(sign * F.col("before_saved")).alias("saved_tokens"),
    )
    return family.join(inside, "node").select(
        "node",
        "parent",
        "parent_conv_id",
        F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        "n_leaves",
        "saved_tokens",
    )


def prefix_trie(conversations: DataFrame, most: int = BLOCK) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text).

    Conversation c is rebuilt from the first h turns of conversation c - c % 5 and its own
    after its first h, h = crc32(c) % 9. Turns come in order of ``turn``, missing numbers
    first, equal ones in order of the md5 of role and text; repeated rows are turns of their
    own. Null roles and texts are empty. Rows without conv_id belong to no conversation and
    are left out. A node is named by its smallest member and its depth. The root has no
    parent. An empty table has no conversations and so no nodes; other columns are not
    looked at. Texts count by their bytes, whatever they hold.
    """
    nodes = trie_nodes(conversations)
    sums = subtree_sums(nodes, most)
    return nodes.join(sums, "node").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        "ends_sha256",
    )

"""Merkle trees over the sections and paragraphs of a text, in SQL functions only.

Sections are parted by an empty line, paragraphs by a line break, so both are found again
when the text is put together and equal roots mean equal texts. A paragraph's node is the
SHA-256 of its text, a section's that of its paragraphs' nodes, the root that of the
sections' nodes. Below each paragraph lie the hashes of its pieces (up to ``PIECE``
characters, starting anew at every sentence end), which tell how much two trees share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeprep.llm.ordering import order_buckets
from codeprep.llm.stage import free_name

PIECE = 32
# Documents that lie next to each other and are looked at together when pairing.
BUCKET_ROWS = 2_000


def tree(text: Column) -> Column:
    """The Merkle tree of a text: its sections, each struct(node, paragraphs[node, leaves]).

    Null counts as the empty text, whose tree is one section with one empty paragraph.
    """
    pattern = F.lit(f"(?s)[^.!?]{{1,{PIECE}}}[.!?]*|[.!?]+")

    def paragraph(p: Column) -> Column:
        pieces = F.regexp_extract_all(p, pattern, F.lit(0))
        leaves = F.transform(pieces, lambda x: F.xxhash64(x))
        return F.struct(F.sha2(p, 256).alias("node"), leaves.alias("leaves"))

    def section(paragraphs: Column) -> Column:
        nodes = F.array_join(F.transform(paragraphs, lambda p: p["node"]), "")
        return F.struct(F.sha2(nodes, 256).alias("node"), paragraphs.alias("paragraphs"))

    sections = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n\n", -1),
        lambda s: F.transform(F.split(s, "\n", -1), paragraph),
    )
    return F.transform(sections, section)


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sections, lambda s: s["node"]), ""), 256)


def leaves(sections: Column) -> Column:
    """The distinct piece hashes of a tree."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                sections,
                lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p["leaves"])),
            )
        )
    )


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    """Shared pieces over the mean number of pieces: 1 for equal roots, 0 for nothing shared."""
    both = F.size(leaves_a) + F.size(leaves_b)
    shared = F.size(F.array_intersect(leaves_a, leaves_b))
    return (
        F.when(root_a == root_b, F.lit(1.0))
        .when(both == 0, F.lit(0.0))
        .otherwise(2.0 * shared / both)
    )


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Places (section, paragraph), both from 0, at which two trees differ.

    Sections with equal nodes are passed over whole; a missing branch differs from any.
    """

    def nodes(sections: Column, at: Column) -> Column:
        found = F.get(sections, at)["paragraphs"]
        return F.coalesce(F.transform(found, lambda p: p["node"]), F.array().cast("array<string>"))

    def inside(at: Column) -> Column:
        left, right = nodes(a, at), nodes(b, at)
        places = F.sequence(F.lit(0), F.greatest(F.size(left), F.size(right)) - 1)
        changed = F.filter(places, lambda i: ~F.get(left, i).eqNullSafe(F.get(right, i)))
        return F.transform(
            changed, lambda i: F.struct(at.alias("section"), i.alias("paragraph"))
        )

    everywhere = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)
    touched = F.filter(
        everywhere, lambda i: ~F.get(a, i)["node"].eqNullSafe(F.get(b, i)["node"])
    )
    return F.flatten(F.transform(touched, inside))


def with_next_text(docs: DataFrame, ident: str, text: str, out: str) -> DataFrame:
    """``ident`` and ``text`` with the text of the next row, by descending ``ident``.

    After the last row comes the first. Null ids come last, equal ids by text. Null texts
    are empty. Rows are dealt into buckets that follow the order (some ``BUCKET_ROWS``
    rows each), and the text crosses one shuffle. What lies beyond a bucket's end is the
    first row of the bucket below, and only those rows are joined.
    """
    rows = docs.select(F.col(ident).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    coarse, bucket = order_buckets(docs.select(F.col(ident).alias("_id")), "_id", BUCKET_ROWS)
    rows = rows.withColumn("_coarse", coarse).withColumn("_bucket", bucket)
    order = [F.desc_nulls_last("_id"), F.asc("_text")]
    inside = Window.partitionBy("_bucket").orderBy(*order)
    rows = rows.withColumns(
        {"_next": F.lead("_text").over(inside), "_at": F.row_number().over(inside)}
    )
    heads = rows.filter("_at = 1").select("_bucket", "_coarse", "_text")
    # Which bucket comes next: inside a coarse range, and across the few coarse ranges.
    known = docs.select(F.col(ident).alias("_id"))
    known = known.select(coarse.alias("_coarse"), bucket.alias("_bucket"))
    buckets = known.groupBy("_bucket", "_coarse").count()
    tops = buckets.groupBy("_coarse").agg(F.max("_bucket").alias("_top"))
    across = Window.orderBy(F.desc("_coarse"))
    everything = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select(
        "_coarse",
        F.coalesce(F.lead("_top").over(across), F.max("_top").over(everything)).alias("_below"),
    )
    down = Window.partitionBy("_coarse").orderBy(F.desc("_bucket"))
    follows = buckets.withColumn("_lower", F.lead("_bucket").over(down)).join(tops, "_coarse")
    follows = follows.select("_bucket", F.coalesce("_lower", "_below").alias("_following"))
    beyond = follows.join(
        heads.select(F.col("_bucket").alias("_following"), F.col("_text").alias("_beyond")),
        "_following",
    ).select("_bucket", "_beyond")
    return rows.join(beyond, "_bucket", "left").select(
        F.col("_id").alias(ident),
        F.col("_text").alias(text),
        F.coalesce("_next", "_beyond").alias(out),
    )


def with_tree(docs: DataFrame, out: str = "tree", text: str = "text") -> DataFrame:
    """``docs`` with the Merkle tree of ``text`` in a new column, renamed if it is taken."""
    return docs.withColumn(free_name(out, docs.columns), tree(F.col(text)))


def compare_with_edit(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints before and after an edit that takes in half of the next document.

    The last floor(n/2) of a text's n code points are replaced by the first as many (or
    all) of the next document's. One row per row of ``docs``, equal rows included; null
    texts count as empty. A single document is its own next one; an empty table gives an
    empty result. Other columns of ``docs`` are not looked at.
    """
    rows = with_next_text(docs.select(ident, text), ident, text, "_other")
    rows = rows.withColumn("n_chars", F.length(text).cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring(F.col(text), F.lit(1), F.col("n_chars").cast("int") - half)
    rows = rows.withColumn(
        "_edited", F.concat(kept, F.substring(F.col("_other"), F.lit(1), half))
    )
    trees = rows.select(
        ident,
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        tree(F.col(text)).alias("_a"),
        tree(F.col("_edited")).alias("_e"),
        tree(F.col("_other")).alias("_o"),
    )
    flat = trees.select(
        ident,
        "n_chars",
        "edited_sha256",
        root(F.col("_a")).alias("fingerprint"),
        root(F.col("_e")).alias("edited_fingerprint"),
        root(F.col("_o")).alias("_root_o"),
        leaves(F.col("_a")).alias("_leaves_a"),
        leaves(F.col("_e")).alias("_leaves_e"),
        leaves(F.col("_o")).alias("_leaves_o"),
        F.size(differing_paragraphs(F.col("_a"), F.col("_e"))).cast("long").alias("n_changed"),
        F.size("_a").cast("long").alias("n_sections"),
    )
    a, la = F.col("fingerprint"), F.col("_leaves_a")
    return flat.select(
        ident,
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(a, la, F.col("edited_fingerprint"), F.col("_leaves_e")).alias("near_edited"),
        likeness(a, la, F.col("_root_o"), F.col("_leaves_o")).alias("near_next"),
        "n_sections",
        "n_changed",
    )

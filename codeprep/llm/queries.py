"""The registered queries of these operators, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeprep.llm import (
    alignment,
    classifier,
    fingerprints,
    jaccard_join,
    mixing,
    pieces,
    prefix_trie,
    quality_rules,
    simhash,
    substring_dedup,
    token_counts,
    token_output,
    url_filters,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id",
        "source",
        "lang",
        mixing.topic(F.col("text")).alias("topic"),
        mixing.token_weight(F.col("text")).alias("n_tokens"),
    )
    return mixing.mixed(docs, ["source", "lang", "topic"], "n_tokens", "doc_id")


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, folder, "documents"), size=4, percent=85)


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return token_counts.token_counts(docs, token_counts.insert_and_delete(F.col("text")))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classifier.classified(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_with_edit(table(spark, folder, "documents"))


def op6_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.judged(table(spark, folder, "pages"))


def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = quality_rules.with_quality(table(spark, folder, "documents"), "q")
    return docs.select("doc_id", "q.*")


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.removal_report(table(spark, folder, "documents"))


def op10_token_output(spark: SparkSession, folder: str) -> DataFrame:
    return token_output.training_order(table(spark, folder, "documents"))


def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.token_alignment(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_jaccard_join,
        op3_token_counts,
        op4_quality_classifier,
        op5_fingerprints,
        op6_url_filters,
        op7_sentencepiece,
        op8_quality_rules,
        op9_substring_dedup,
        op10_token_output,
        op11_simhash,
        op12_prefix_trie,
        op13_alignment,
    )
}

# Fixed value: what the contract takes for a word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Raking, learned models, zstandard, hashes of one engine and tokenizers have no SQL form that
# gives the same rows; those queries are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op2_jaccard_join": f"""
        WITH RECURSIVE d AS (
          SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w
          FROM documents),
        s AS (
          SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS g
          FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d
                WHERE len(w) > 0)),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        p AS (SELECT a.r AS x, b.r AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.r < b.r
              GROUP BY a.r, b.r),
        l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y
              WHERE 100 * i >= 85 * (a.n + b.n - i)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        reach AS (SELECT r, r AS q FROM d UNION SELECT reach.r, e.y FROM reach JOIN e ON q = e.x)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles,
          min(other.doc_id) AS component_id
        FROM d JOIN reach USING (r) JOIN d other ON other.r = reach.q LEFT JOIN n ON n.r = d.r
        GROUP BY d.r, d.doc_id""",
    "op9_substring_dedup": f"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id,
            regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
        g AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g
              FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
        again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM g)
                  WHERE n > 1),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS spot FROM again),
        kept AS (
          SELECT r, string_agg(word, ' ' ORDER BY spot) AS words, count(*) AS n
          FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS spot FROM d)
          ANTI JOIN gone USING (r, spot) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
          sha256(coalesce(words, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)""",
    "op12_prefix_trie": """
        WITH t AS (
          SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id
            ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS r
          FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
                FROM conversations WHERE conv_id IS NOT NULL)),
        c AS (
          SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
              flatten([[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]
                       FOR x IN string_split(conv_id::VARCHAR, '')]),
              lambda s, b: CASE WHEN b >= 0 THEN xor(s, b)
                ELSE xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END) END,
              4294967295::BIGINT)) % 9 AS h
          FROM t GROUP BY conv_id),
        b AS (
          SELECT c.conv_id, 0 AS own, r, role, text FROM c JOIN t ON t.conv_id = c.base AND r <= h
          UNION ALL
          SELECT conv_id, 1, r, role, text FROM c JOIN t USING (conv_id) WHERE r > h),
        d AS (
          SELECT conv_id, strlen(text) AS size,
            row_number() OVER (PARTITION BY conv_id ORDER BY own, r) AS depth,
            string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY own, r) AS k
          FROM b),
        m AS (
          SELECT conv_id, depth, size, k, left(k, -64) AS p FROM d
          UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
        ends AS (
          SELECT depth, k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
          FROM m JOIN (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id)
          USING (conv_id, depth) GROUP BY depth, k),
        v AS (
          SELECT depth, k, p, min(conv_id) AS conv_id, count(*) AS n_convs,
            (count(*) - 1) * any_value(size) AS saved FROM m GROUP BY depth, k, p),
        kids AS (SELECT p AS k, count(*) AS n FROM v WHERE depth > 0 GROUP BY p),
        below AS (
          SELECT m.depth, m.k, sum(saved) AS saved, sum((n IS NULL)::INT) AS leaves
          FROM (SELECT v.*, n FROM v LEFT JOIN kids USING (k)) AS x
          JOIN m ON m.conv_id = x.conv_id AND m.depth <= x.depth GROUP BY m.depth, m.k)
        SELECT v.conv_id, v.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, v.n_convs,
          coalesce(kids.n, 0) AS n_children, below.leaves::BIGINT AS n_leaves,
          below.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM v JOIN below USING (depth, k) LEFT JOIN kids USING (k) LEFT JOIN ends USING (depth, k)
        LEFT JOIN v AS above ON above.k = v.p AND above.depth = v.depth - 1""",
}

from codeprep.llm import token_counts, token_output, url_filters
from pyspark.sql import functions as F

BAD = "SELECT 1L doc_id, CAST(X'61FF62' AS STRING) text UNION ALL SELECT 2L, 'a\ufffdb'"


def test_token_counts(spark):
    docs = spark.sql(BAD)
    found = token_counts.token_counts(docs, token_counts.insert_and_delete(F.col("text"))).collect()
    first, second = sorted(found, key=lambda r: r.doc_id)
    assert tuple(first)[1:] == tuple(second)[1:] and first.n_tokens > 0


def test_token_output(spark):
    found = token_output.training_order(spark.sql(BAD))
    assert found.count() > 0


def test_url_filters(spark):
    pages = spark.sql("SELECT 1L page_id, CAST(X'687474703A2F2F61FF2E636F6D2F78' AS STRING) url")
    row = url_filters.judged(pages).first()
    assert row.verdict in ("allow", "block") and row.rule is None

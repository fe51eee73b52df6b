import os
import subprocess
import sys

import pytest

import corpus_pipeline
from codeprep.llm import queries as Q

from .test_jaccard_join import brute as brute_groups

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..")
FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_stages_take_and_return_documents(spark, odd_docs, tmp_path):
    docs, seen = odd_docs, {}
    for name, step in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        step(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        if name != "sentence pieces":
            assert sorted(docs.columns) == sorted(odd_docs.columns)
    kept = seen["quality rules"]
    assert {4, 5, 6, 7, 8, 9, 10} <= set(kept) and not {1, 2, 3, 11, 14, 17} & set(kept)
    groups = {d: c for d, _, c in brute_groups(list(kept.items()), 5, 80)}
    assert set(seen["near duplicates"]) == set(groups.values())
    assert set(seen["mixing"]) <= set(seen["substring dedup"]) <= set(seen["near duplicates"])
    assert set(docs.columns) - set(odd_docs.columns) == {"piece_ids", "n_pieces"}
    assert seen["sentence pieces"] == seen["mixing"]


def test_empty_table(spark, no_docs, tmp_path):
    docs = no_docs
    for name, step in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        step(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() == 0


@needs_tables
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_has_a_row_per_input_row(spark, name):
    found = Q.QUERIES[name](spark, FOLDER)
    if name == "op10_token_output":
        assert found.count() == found.select("slot").distinct().count() > 0
        return
    if name == "op12_prefix_trie":
        assert found.count() == found.select("conv_id", "depth").distinct().count() > 0
        return
    source = "pages" if name.startswith("op6") else "documents"
    assert found.count() == spark.read.parquet(f"{FOLDER}/{source}.parquet").count()


@needs_tables
@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, rows, name):
    import duckdb

    duck = duckdb.connect()
    for source in ("documents", "conversations", "pages"):
        duck.execute(f"CREATE VIEW {source} AS SELECT * FROM '{FOLDER}/{source}.parquet'")
    result = duck.execute(Q.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert rows(Q.QUERIES[name](spark, FOLDER), *columns) == sorted(result.fetchall(), key=repr)


def test_registered_only_where_present():
    code = (
        "import sys, importlib.abc\n"
        "class Hide(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('codeprep.llm', 'corpus_pipeline'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Hide())\n"
        "import __spark_entry__ as e\n"
        "assert 'processed_fact' in e.queries() and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    import __spark_entry__

    assert {"pipeline", *Q.QUERIES} <= set(__spark_entry__.queries())

"""The first rows of each query: as ranks over all scores, which were shuffled before."""

import pytest
from pyspark.sql import functions as F

from annalist.operators import selection
from annalist.operators.lexical import bm25, tokenized, top_each
from annalist.plans import retrieval

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("k", [1, 5, 400])
def test_foremost(spark, monkeypatch, k):
    monkeypatch.setattr(selection, "QUERIES", 8)  # many blocks
    monkeypatch.setattr(selection, "ROWS", 16)
    words = ["amber", "birch", "cedar", "delta", *(f"word{i}" for i in range(40))]
    text = lambda i: " ".join(words[(i * i * 7 + j * (i % 11 + 1)) % (4 if j % 3 else len(words))] for j in range(i * 37 % 61))
    rows = [(i, text(i - 5 if i % 9 == 8 else i)) for i in range(150)]  # ties, empty texts
    rows += [(3, text(3)), (4, text(40)), (None, text(7)), (200, "")]
    docs = tokenized(spark.createDataFrame(rows, "id long, content string")).select("id", "tokens", F.size("tokens").alias("dl"))
    queries = spark.createDataFrame([(i, text(i)) for i in range(0, 150, 5)] + [(300, "birch nowhere"), (301, "nowhere"), (None, "cedar"), (-1, None)], "qid long, query string")
    want = top_each(bm25(docs, queries), "qid", k, F.desc("relevance"), "id").select("qid", "rank", "id", "relevance")
    got = selection.foremost(docs.repartition(5), queries, k)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert not selection.foremost(docs, queries.where("qid = 301"), k).count()


def test_no_pairs_are_shuffled(spark):
    """All pairs of queries and rows that share a word were shuffled before; the replicated pairs are of blocks."""
    plan = retrieval.bm25_batch_queries(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1 and "CartesianProduct" in plan

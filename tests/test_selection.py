"""Candidates of a budget against the whole ranking: nothing that it picks is missing, and few others are there."""

import pytest
from pyspark.sql import functions as F

from annalist.operators import selection
from annalist.operators.evaluate import budgeted
from annalist.operators.lexical import bm25, tokenized


def budget(hits, items, bytes_):
    rows = budgeted(hits.select("qid", "id", F.struct(-F.col("relevance"), "id").alias("rank"), "bytes"), items, bytes_)
    return sorted(map(tuple, rows.select("qid", "rank", "id").collect()))


def tables(spark, n):
    words = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heron", *(f"word{i}" for i in range(40))]
    text = lambda i: " ".join(words[(i * i * 7 + k * (i % 11 + 1)) % (8 if k % 3 else len(words))] for k in range(i * 37 % 61))
    rows = [(i, text(i - 5 if i % 9 == 8 else i)) for i in range(n)]  # some are copies: ties, and some are empty
    rows += [(3, text(3)), (4, text(40)), (n, None)]  # ids that come twice
    t = spark.createDataFrame(rows, "id long, content string").withColumn("content", F.coalesce("content", F.lit("")))
    docs = tokenized(t).select("id", "tokens", F.size("tokens").alias("dl"))
    queries = spark.createDataFrame([(i, text(i)) for i in range(0, n, 3)] + [(n + 5, "birch nowhere"), (n + 6, "nowhere"), (None, "cedar")], "qid long, query string")
    return docs, queries, t.select("id", F.octet_length("content").cast("long").alias("bytes")).distinct()


@pytest.mark.parametrize("items,bytes_", [(5, 400), (1, 90), (3, 4096), (5, 0)])
def test_candidates(spark, monkeypatch, items, bytes_):
    monkeypatch.setattr(selection, "QUERIES", 16)  # many blocks
    monkeypatch.setattr(selection, "BLOCKS", 2)
    docs, queries, sizes = tables(spark, 150)
    whole = bm25(docs, queries).where("qid <> id").join(sizes, "id")
    some = selection.candidates(docs, queries, sizes, items, bytes_)
    assert budget(some, items, bytes_) == budget(whole, items, bytes_)
    assert not some.exceptAll(whole.select(some.columns)).count()


def test_few_candidates(spark):
    """The pairs were shuffled before, all of them."""
    docs, queries, sizes = tables(spark, 600)
    some = selection.candidates(docs, queries, sizes, 5, 4096)
    assert some.groupBy("qid").count().agg(F.max("count")).first()[0] < 150
    assert bm25(docs, queries).groupBy("qid").count().agg(F.max("count")).first()[0] > 300


def test_parts(spark, monkeypatch):
    """Rows in many parts: each part's candidates were shuffled before, now the last part gives what the budget picks."""
    monkeypatch.setattr(selection, "ROWS", 16)
    monkeypatch.setattr(selection, "BLOCKS", 2)
    docs, queries, sizes = tables(spark, 150)
    some = selection.candidates(docs.repartition(7), queries, sizes, 5, 400)
    assert budget(some, 5, 400) == budget(bm25(docs, queries).where("qid <> id").join(sizes, "id"), 5, 400)
    assert some.groupBy("qid").count().agg(F.max("count")).first()[0] <= 5
    once = docs.where("id not in (3, 4, 150)").join(sizes, "id")  # own sizes
    some, whole = selection.candidates(once.repartition(7), queries, None, 5, 400), bm25(once, queries).where("qid <> id").join(sizes, "id")
    assert budget(some, 5, 400) == budget(whole, 5, 400)


def test_salt(spark, monkeypatch):
    """Words whose hashes meet get others."""
    real, rows = F.xxhash64, spark.createDataFrame([("a",), ("b",)], "word string")
    assert selection.salted(rows) == 0
    asked = iter([lambda *c: F.lit(1).cast("long"), real])
    monkeypatch.setattr(selection.F, "xxhash64", lambda *c: next(asked)(*c))
    assert selection.salted(rows) == 1


def test_few_terms_at_once(spark, monkeypatch):
    """Products of few frequent terms and few pairs at a time give the same scores."""
    import numpy as np

    rng = np.random.default_rng(3)
    term = np.sort(rng.choice(10**6, 60, replace=False)).astype(np.int64)
    asks = [rng.choice(60, rng.integers(1, 20), replace=False) for _ in range(30)]
    says = [np.sort(rng.choice(60, rng.integers(0, 30), replace=False)) for _ in range(50)]
    flat = lambda x: np.concatenate([*x, np.zeros(0, int)]).astype(int)
    query = [np.arange(30), np.r_[0, np.cumsum([len(a) for a in asks])], term[flat(asks)], rng.random(sum(map(len, asks)))]
    rows = [np.arange(50), np.arange(50, dtype=np.int32), np.arange(50, dtype=np.int16), rng.random(50) + 0.5, np.repeat(np.arange(50), [len(x) for x in says]).astype(np.int32), term[flat(says)], np.ones(sum(map(len, says)), np.int32)]
    want = np.zeros((30, 50))
    for q, a in enumerate(asks):
        for d, s in enumerate(says):
            w = dict(zip(a.tolist(), query[3][query[1][q] : query[1][q + 1]].tolist()))
            want[q, d] = sum(w[x] / (1 + rows[3][d]) for x in s.tolist() if x in w)
    for matrix, pairs, width in ((512, 1 << 21, 50), (2, 3, 50), (7, 40, 1)):
        monkeypatch.setattr(selection, "MATRIX", matrix)
        monkeypatch.setattr(selection, "PAIRS", pairs)
        assert np.allclose(selection.scores(query, rows), want)

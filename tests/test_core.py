"""Goldens, oracles and properties of the core engine."""

import json
import math

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annalist import queries
from annalist.functions import text as T
from annalist.operators.evaluate import budgeted
from annalist.operators.expand import expand
from annalist.operators.governance import contradictions, versions
from annalist.operators.lexical import bm25, query_frame
from annalist.operators.vector import cosine, fused
from annalist.plans.relations import said as phrase_rows
from annalist.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "content string").select(column(F.col("content")).alias("x")).first()["x"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(str(tuple(map(norm, r))) for r in df.select(columns).collect())
    if name not in queries.ORACLE_SQL:
        assert got
        return
    r = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(r.columns) == columns
    want = sorted(str(tuple(float(x) if type(x).__name__ == "Decimal" else norm(x) for x in row)) for row in r.select(",".join(f'"{c}"' for c in columns)).fetchall())
    assert got == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("Coffee shop, the BEST one2!", ["coffee", "shop", "best", "one2"]),
        ("我a爱b你", ["我", "爱", "你"]),
        ("福州市 x", ["福州", "州市"]),
        ("éage naïve", ["age", "na", "ve"]),
        ("", []),
        (None, []),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens, text) == want


def test_bm25_numbers(spark):
    rows = spark.createDataFrame([(1, "alpha alpha beta"), (2, "alpha"), (3, "gamma"), (4, "delta")], "id long, content string")
    got = {r["id"]: r["relevance"] for r in bm25(rows, query_frame(rows, "alpha")).collect()}
    idf = math.log1p(2.5 / 2.5)
    assert got[1] == round(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 1.5)), 4) and set(got) == {1, 2}


def test_fusion_and_cosine(spark):
    rows = spark.createDataFrame([(1, 2.0, 0.1), (2, 1.0, 0.9), (3, 0.5, None)], "id long, relevance double, similarity double")
    got = {r["id"]: r["search_score"] for r in fused(rows).collect()}
    assert got == {1: round(1 / 61 + 1 / 62, 8), 2: round(1 / 62 + 1 / 61, 8), 3: None}
    bad = spark.createDataFrame([([1.0, float("nan")], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="finite"):
        bad.select(cosine(F.col("a"), F.col("b"))).collect()


def said(spark, rows):
    return spark.createDataFrame([(k, s, t, k, 0, 1) for k, (s, t) in enumerate(rows)], "id long, source string, content string, moment long, position long, user int")


def test_versions_and_contradictions(spark):
    rows = said(spark, [("a", "I live in Paris"), ("a", "I moved to Berlin"), ("b", "I moved to Rome"), ("a", "She loves cats and dogs"), ("a", "She hates cats and dogs"), ("a", "x " * 90 + "I moved to Oslo")])
    assert {(r["old_id"], r["new_id"]) for r in versions(rows, "user").collect()} == {(0, 1)}
    assert {(r["a"], r["b"], r["signal"]) for r in contradictions(rows, "user").collect()} == {(3, 4, "en-opposite")}


def test_contradictions_and_windows_of_conversations(spark, tmp_path):
    texts = ["She loves cats and dogs", "He works at the bank in London", "She hates cats and dogs", "He works at the bank in London and quit to move to the bank in Paris", "She hates cats and dogs"]
    rows = [(c, k, "ann" if c < 3 or k % 2 else "bob", t) for c, own in ((1, texts), (2, texts[:1]), (3, texts[2:4] + texts[:1]), (4, [texts[0], texts[2]])) for k, t in enumerate(own)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()]
    phrase = {(-a, -b, s) for a, b, s in map(tuple, contradictions(phrase_rows(spark), "user").collect())}
    pairs = run("contradiction_pairs_sessions")
    assert {p for p in pairs if p[0] > 0} == {(1000, 1002, "en-opposite"), (1000, 1004, "en-opposite"), (3000, 3002, "en-opposite")}
    assert (-3, -4, "en-opposite") in pairs and {p for p in pairs if p[0] < 0} <= phrase
    assert not {x for x, _ in run("contradiction_partners_sessions")} & {1000, 1002} and (-3, 0.5) in run("contradiction_partners_sessions")
    window = {(q, i): s for q, i, s in run("govern_window_sessions")}
    assert (1, 1002) not in window and (1, 1004) in window and (2, 2000) in window and window[1, 1001] == 0.125 and window[1, 1003] == 0.25
    assert len(window) == 10 + sum(1 for q, _ in window if q < 0)


def test_pair_blocks_cover_exactly_the_recent_ones(spark):
    from annalist.operators.governance import pairs

    rows = said(spark, [("a", "x")] * 23)
    got = {(r["old"]["id"], r["new"]["id"]) for r in pairs(rows, "user", 5).collect()}
    assert got == {(i, j) for i in range(23) for j in range(23) if 0 < j - i <= 5}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=12))
def test_budget_skips_what_does_not_fit(spark, sizes):
    rows = spark.createDataFrame([(0, k, k + 1, n) for k, n in enumerate(sizes)], "qid long, id long, rank int, bytes long")
    got = [r["id"] for r in budgeted(rows, 4, 15).orderBy("rank").collect()]
    want, used = [], 0
    for k, n in enumerate(sizes):
        if used + n <= 15 and len(want) < 4:
            want.append(k)
            used += n
    assert got == want


def test_budget_goes_down_the_whole_ranking(spark, tmp_path):
    long = ("needle " * 40 + "x" * 1800).split(" ", 40)
    turns = [(0, 0, "user", "needle"), (0, 1, "user", "needle " + "filler " * 60)]
    turns += [(c, 1, "user", " ".join(long) + f" {c}") for c in range(1, 81)] + [(c, 1, "user", "needle " * 30 + "y" * 4500) for c in range(81, 91)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["qid"]: r["id"] for r in queries.QUERIES["budget_select"](spark, str(tmp_path)).orderBy("rank").collect()}
    assert got == {0: 1}  # only one long turn fits, and after it the short one at the end of the ranking
    assert [tuple(r) for r in queries.QUERIES["retrieval_metrics"](spark, str(tmp_path)).collect()] == [(0, 1.0, 1, 0.5)]


def test_expansion_keeps_seeds_and_takes_turns(spark):
    ranked = spark.createDataFrame([(0, i, i, i // 4, i % 4) for i in range(1, 13)], "qid long, id long, rank int, session_id long, position long")
    links = spark.createDataFrame([(1, 12, "related"), (11, 1, "explains")], "from_id long, to_id long, relation string")
    out = expand(ranked, links, 5).orderBy("place").toPandas()
    assert out["id"].tolist() == [1, 2, 3, 11, 12] or out["id"].tolist()[:3] == [1, 2, 3]
    assert out["via"].tolist()[:3] == ["seed"] * 3 and len(out) == 5 and out["id"].is_unique


def test_chunks_round_trip(spark):
    text = "A sentence here. " * 200
    got = one(spark, T.chunks, text)
    assert len(got) > 1 and all(len(c) <= 1217 for c in got) and " ".join(got) == text.strip()
    assert one(spark, T.chunks, "short. text.") == ["short. text."]


def test_stream_is_idempotent(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    message = {"role": "user", "content": "You must lock the door.", "timestamp": 1704067200000}
    ok = {"request_id": "r1", "user_id": "u", "session_id": "s", "messages": [message, message]}
    (source / "a.json").write_text("\n".join([json.dumps(ok), json.dumps(ok), "{broken", json.dumps(ok | {"request_id": "r2", "messages": []})]))
    run = lambda: ingest.stream(spark.readStream.text(str(source)), store, str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    run()
    (source / "b.json").write_text("\n".join([json.dumps(ok), json.dumps(ok | {"request_id": "r3"})]))
    run()
    rows = spark.read.parquet(store).orderBy("position").collect()
    assert [(r["request_id"], r["position"]) for r in rows] == [("r1", 0), ("r1", 1), ("r3", 2), ("r3", 3)]
    assert rows[0]["material_type"] == "rule" and not rows[0]["security_sensitive"]
    assert sorted(r["reason"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["malformed", "no_messages"]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert isinstance(entry.queries(), dict) and pd is not None

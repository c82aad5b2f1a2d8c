"""The stateful stream equals one fold over all messages, wherever its batches are cut."""

import random

import pytest
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators.governance import contradictions, versions
from annalist.sources.phrases import phrases
from annalist.streaming import history


def messages(spark, copies=3):
    """Phrases said by several users in several sessions, in a shuffled order; every seventh request comes twice."""
    texts = [r["content"] for r in phrases(spark).orderBy("id").collect()]
    r = random.Random(3)
    rows, n = [], 0
    for user in range(copies):
        own = texts * 2
        r.shuffle(own)
        for k, text in enumerate([*own, "word " * 400 + ". " + "Another sentence. " * 40, None, ""]):
            n += 1
            rows.append((f"u{user}", f"s{user}-{k % 4}", f"r{n}", 0, n, n, r.choice(["user", "assistant"]), text, 1000 + n))
    return rows


def run(spark, tmp_path, name, parts):
    folder = tmp_path / f"{name}-in"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, history.MESSAGE).coalesce(1).write.mode("append").parquet(str(folder))
        history.start(spark.readStream.schema(history.MESSAGE).parquet(str(folder)), str(tmp_path / name), str(tmp_path / f"{name}-cp")).awaitTermination()
    return {t: sorted(map(str, history.read(spark, str(tmp_path / name), t).collect())) for t in ("turns", "versions", "contradictions", "summaries")}


@pytest.fixture(scope="module")
def rows(spark):
    return messages(spark)


def test_batches_and_restarts_make_no_difference(spark, tmp_path, rows):
    whole = run(spark, tmp_path, "whole", [rows + rows[::7]])
    cut = run(spark, tmp_path, "cut", [rows[:50], rows[40:120], rows[120:] + rows[::7]])
    assert whole == cut
    assert whole["versions"] and whole["contradictions"] and len(whole["summaries"]) == 12


def test_edges_equal_the_batch_rules(spark, tmp_path, rows):
    """Statements of one user in the order of arrival, those 300 before: the same edges as the join over all of them finds."""
    run(spark, tmp_path, "edges", [rows])
    table = spark.createDataFrame(rows, history.MESSAGE).withColumns({"content": F.coalesce("content", F.lit("")), "position": F.lit(0).cast("long")})
    for name, want in (("versions", versions(table, "user_id")), ("contradictions", contradictions(table, "user_id"))):
        assert sorted(map(tuple, history.read(spark, str(tmp_path / "edges"), name).collect())) == sorted(map(tuple, want.collect()))


def test_places_and_summaries_equal_a_fold(spark, tmp_path, rows):
    out = run(spark, tmp_path, "fold", [rows])
    frame = spark.createDataFrame(rows, history.MESSAGE).withColumn("content", F.coalesce("content", F.lit("")))
    said = {r["id"]: r for r in frame.select("id", "session_id", F.size(T.chunks(F.col("content"))).alias("n"), T.point(F.col("content")).alias("point")).collect()}
    places, summaries = {}, {}
    for row in rows:
        m = said[row[5]]
        places.setdefault(m["session_id"], []).extend([row[5]] * m["n"])
        summaries[m["session_id"]] = history.appended(summaries.get(m["session_id"], ""), m["point"])
    got = history.read(spark, str(tmp_path / "fold"), "turns").orderBy("session_id", "position").collect()
    assert {s: [r["id"] for r in got if r["session_id"] == s] for s in places} == places
    assert all(r["position"] == k for s in places for k, r in enumerate(x for x in got if x["session_id"] == s))
    assert {r["session_id"]: r["summary"] for r in history.read(spark, str(tmp_path / "fold"), "summaries").collect()} == summaries
    assert out["turns"]


def test_a_long_summary_keeps_head_and_tail():
    summary = ""
    for k in range(200):
        summary = history.appended(summary, f"point {k} " + "x" * 50)
    assert len(summary) <= 4000 and summary.startswith("point 0 ") and "point 199 " in summary and "\n…\n" in summary
    assert history.appended(summary, summary.split("\n")[-1]) == summary and history.appended(summary, "") == summary


def test_recent_statements_are_bounded():
    recent = history.Recent([])
    for k in range(1000):
        recent.add((k, "user", "t", k, 0, f"common\nown{k}", "", ""))
    assert len(recent.rows) == history.RECENT and set(recent.by_key["wcommon"]) == set(range(700, 1000))
    assert [r[0] for r in recent.candidates((1, "user", "t", 1, 0, "common\nown900", "", ""))] == [900]


def test_small_files_are_dealt_out(spark, tmp_path, rows):
    """One task made the profiles of a file before, here all of them."""
    from annalist.operators.governance import dealt, profiled

    table = spark.createDataFrame(rows, history.MESSAGE).coalesce(1)
    assert profiled(dealt(table, "user_id")).rdd.getNumPartitions() == 8
    plan = versions(table.withColumn("position", F.lit(0).cast("long")), "user_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [user_id" in plan


def test_profiles_of_pairs_are_made_once(spark, tmp_path, monkeypatch, rows):
    """Both sides' profiles were written into each rule before, a time for each look at them."""
    real, plans = history.judged, []

    def judged(both):
        out = real(both)
        plans.extend(df._jdf.queryExecution().withCachedData().toString() for df in out)
        return out

    monkeypatch.setattr(history, "judged", judged)
    run(spark, tmp_path, "once", [rows[:60]])
    assert len(plans) == 2 and all("InMemoryRelation [user_id" in p and "old" in p for p in plans)

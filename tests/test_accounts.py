"""Narratives replay the claims that they cite, states of memories leave the replay once, the ledger gives what is read."""

from pyspark.sql import functions as F

from annalist.operators import claims as C
from annalist.operators import lifecycle as L
from annalist.plans import judgments, lives

SF = "/root/testdata/sf0.01"


def test_cited_claims_alone(spark, monkeypatch):
    """All claims were replayed before, whatever the narratives cited."""
    real, seen = C.view, []
    monkeypatch.setattr(judgments.C, "view", lambda claims, commands, as_of: seen.append(commands) or real(claims, commands, as_of))
    judgments.account_issues(spark, SF)
    cited = judgments.accounts(spark, SF).where("claim_ids is not null").select(F.explode(F.from_json("claim_ids", "array<string>")).alias("c")).select(F.floor(F.col("c").cast("long") / 10).alias("grp"))
    want = judgments.commands(spark, SF).join(cited.distinct(), "grp", "left_semi")
    got = seen[0].select(want.columns)
    assert 0 < got.count() < judgments.commands(spark, SF).count() / 4
    assert not got.exceptAll(want).count() and not want.exceptAll(got).count()


def test_last_states(spark):
    """Every command's state left the replay before, and an aggregate kept the last."""
    rows = lives.acts(spark, SF)
    names = [x.split()[0] for x in L.STATE.replace("scope: string, at: long", "").split(", ")]
    want = L.replay(rows).groupBy("memory_id").agg(F.max_by(F.struct(*names), "seq").alias("s")).select("memory_id", "s.*").where("known")
    got = L.last_states(rows)
    assert got.columns == want.columns and got.count() > 100
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "max_by" not in lives.states(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_last_states_of_odd_commands(spark):
    fields = "seq long, memory_id long, moment long, op string, label string, scope string, source string, tier string, sensitive boolean"
    made = (10, "remember", None, None, "s1", "archive", None)
    rows = [(1, 1, *made), (2, 1, None, "promote", None, None, None, None, None), (3, 1, 2**60 + 1, "pin", None, None, None, None, None), (4, 2, 5, "pin", None, None, None, None, None), (5, 3, None, "remember", None, None, None, "testimony", True), (6, None, *made)]
    got = {r["memory_id"]: r for r in L.last_states(spark.createDataFrame(rows, fields)).collect()}
    assert set(got) == {1}  # 2 was never captured, 3 was refused
    assert (got[1]["status"], got[1]["pinned_at"], got[1]["consolidated_at"], got[1]["sensitive"], got[1]["canon"]) == ("consolidated", 2**60 + 1, None, False, [])
    assert not L.last_states(spark.createDataFrame([], fields)).collect()


def test_answers_that_are_read(spark):
    """All thirteen fields came back from Python before."""
    some = C.ledger(judgments.commands(spark, "/root/testdata/sf0.001"), "op", "memory_id")
    assert some.columns == ["op", "memory_id"]
    assert not some.exceptAll(judgments.answers(spark, "/root/testdata/sf0.001").select("op", "memory_id")).count()
    plan = judgments.ledger_answers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "origin_id" not in next(x for x in plan.splitlines() if "MapInArrow" in x).split("]")[-1]

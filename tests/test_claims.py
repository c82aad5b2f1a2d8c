"""The ledger's replay by columns: answers to awkward commands, and views that replay once."""

from annalist.operators import claims as C
from annalist.plans import judgments

SF = "/root/testdata/sf0.001"
FIELDS = "grp long, at long, rank int, claim_id long, op string, scope string, sensitive boolean, evidence_id string, memory_id long, stance string, origin_id long, quoted boolean, gone_at long, memory_sensitive boolean, corroborated boolean, stale_at long, other_id long"


def commands(spark, *rows):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return spark.createDataFrame([tuple({"grp": 0, "rank": 0, "claim_id": 1, **r}.get(n) for n in names) for r in rows], FIELDS)


def cites(at, eid, **more):
    return {"at": at, "op": "evidence", "evidence_id": eid, "memory_id": 7, "stance": "supports", "quoted": True, "memory_sensitive": False, "corroborated": True} | more


ROWS = [
    {"at": 1, "op": "create", "scope": "s", "sensitive": False},
    cites(2, "a"),
    cites(3, "b"),  # the same source and stance
    cites(3, "c", memory_id=8, gone_at=3),
    cites(3, "d", memory_id=8, quoted=None),
    cites(3, "e", memory_id=2**60 + 1, origin_id=2**60 + 1, stance="challenges"),
    {"at": 4, "op": "retract", "evidence_id": "a"},
    {"at": 5, "op": "retract", "evidence_id": "a"},
    {"at": 6, "op": "adopt"},  # nothing supports it
    cites(7, "b", origin_id=5),
    {"at": 8, "op": "adopt"},
    {"at": 9, "op": "revise", "other_id": 2},
    {"at": 9, "op": "withdraw", "claim_id": 3},
]


def test_answers(spark):
    got = {(r["at"], r["evidence_id"] or r["op"]): (r["answer"], r["sequence"]) for r in C.ledger(commands(spark, *ROWS)).collect()}
    assert got == {
        (1, "create"): ("proposed", 1), (2, "a"): ("evidence_added", 2), (3, "b"): ("same", None), (3, "c"): ("denied_forgotten", None), (3, "d"): ("denied_quote", None), (3, "e"): ("evidence_added", 3),
        (4, "a"): ("evidence_retracted", 4), (5, "a"): ("noop", None), (6, "adopt"): ("denied_support", None), (7, "b"): ("evidence_added", 5), (8, "adopt"): ("adopted", 6), (9, "revise"): ("denied_replacement", None), (9, "withdraw"): ("unknown_claim", None),
    }
    assert {r["memory_id"] for r in C.ledger(commands(spark, *ROWS)).where("evidence_id = 'e'").collect()} == {2**60 + 1}


def test_views(spark):
    claims = spark.createDataFrame([(1, "s", False, 1), (2, "s", False, 1)], "id long, scope string, sensitive boolean, recorded_at long")

    def shown(as_of):
        fields = ["status", "supporting", "challenging", "origins", "unknown_origins", "redacted", "review_required", "eligible"]
        return {r["id"]: tuple(r[f] for f in fields) for r in C.view(claims, commands(spark, *ROWS), as_of).collect()}

    assert shown(3) == {1: ("proposed", 1, 1, 0, 1, False, False, False), 2: ("proposed", 0, 0, 0, 0, False, False, False)}
    assert shown(5)[1] == ("proposed", 0, 1, 0, 0, False, False, False)
    assert shown(None)[1] == ("adopted", 1, 1, 1, 0, False, False, True)
    assert shown(0) == {}


def test_views_replay_once(spark):
    """Two replays before: one for states, one for evidence; and the joins of line items were made a time for retractions too."""
    plan = judgments.ledger_view_now(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert sum("FileScan parquet" in x and "l_orderkey" in x for x in plan.splitlines()) == 2

"""Times of requests: each is read once, whatever rules look at it, and only where a request of its kind has it."""

import json

from annalist.functions import rules as R
from annalist.functions import vocab as V


def judge(spark, *rows):
    some = spark.createDataFrame([(kind, json.dumps(v), k) for k, (kind, v) in enumerate(rows)], "kind string, value string, k int")
    return [r["reasons"] for r in R.judged(some).orderBy("k").collect()]


def test_times_are_read_once(spark):
    """The rules on times and on their order each read them anew, and each part of a time looked it up in the request."""
    plan = R.judged(spark.createDataFrame([("claim", "{}")], "kind string, value string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(V.ISO_TIME) == 6  # paths


def test_times_of_other_types_and_kinds(spark):
    time, other = "2024-01-02T00:00:00Z", "2024-01-01T23:59:59.999999-00:30"
    claim = {"content": "c", "reason": "r", "kind": "plan"}
    ends = {"valid_from": other, "valid_until": time}
    rows = [{"statement_at": time}, {"statement_at": 17}, {"statement_at": [time]}, {"statement_at": {"a": time}}, {"statement_at": None}, {"statement_at": "2024-01-02"}, ends, {"valid_from": time, "valid_until": time}, {"valid_from": "soon", "valid_until": time}, {"since": "soon"}]
    assert judge(spark, *(("claim", claim | r) for r in rows)) == [[], ["statement_at"], ["statement_at"], ["statement_at"], [], ["statement_at"], ["valid_order"], [], ["valid_from"], []]
    assert judge(spark, ("range", {"since": time, "until": True}), ("range", {"valid_from": 5}), ("capture", {"content": "c", "event_at": "x"}), ("capture", {"content": "c", "event_at": time})) == [["until"], [], ["event_at"], []]


def test_zones_and_line_ends(spark):
    """An end of line after a time counts as before; so do zones up to a day."""
    rows = [("2024-01-02T00:00:00Z\n", []), ("2024-01-02T00:00:00.5+05:30\n", []), ("2024-01-02T00:00:00+23:59", []), ("2024-01-02T00:00:00+24:00", ["since"]), ("2024-01-02T00:00:00-00:99", []), ("2024-01-02T00:00:00+0530", ["since"]), ("0000-01-02T00:00:00Z", ["since"]), ("x2024-01-02T00:00:00Z", ["since"]), ("2024-01-02T00:00:00.1234567Z", ["since"])]
    assert judge(spark, *(("range", {"since": t}) for t, _ in rows)) == [want for _, want in rows]

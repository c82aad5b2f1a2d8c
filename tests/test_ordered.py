"""Blocks of an order against plain loops, and the join by time."""

import random

from pyspark.sql import functions as F

from annalist.operators.lexical import numbered
from annalist.operators.lifecycle import first_after
from annalist.operators.ordered import following, running_max


def made(seed):
    r = random.Random(seed)
    return [(k, r.choice(["a", "b", None]), r.randint(-60, 60), r.choice([None, *range(50)])) for k in range(200)]


def test_running_max(spark):
    rows = [(k, s, n, v) for k, (_, s, n, v) in enumerate(made(1))]
    out = running_max(spark.createDataFrame(rows, "id int, key string, n int, v int"), "key", "n", "v", "top", width=7).collect()
    assert {r["id"]: r["top"] for r in out} == {k: max((v for _, s2, n2, v in rows if s2 == s and n2 <= n and v is not None), default=None) for k, s, n, _ in rows}


def test_following(spark):
    rows = made(2)
    out = following(spark.createDataFrame(rows, "id int, key string, n int, v int"), "key", ["n", "id"], {"next": "id", "next_v": "v"}, width=9).collect()
    for r in out:
        later = min(((n, k, v) for k, s, n, v in rows if s == r["key"] and (n, k) > (r["n"], r["id"])), default=(None, None, None), key=lambda x: x[:2])
        assert (r["next"], r["next_v"]) == later[1:]


def test_first_after(spark):
    r = random.Random(3)
    asks = [(r.choice("ab"), k * 50 + r.randint(0, 40), k) for k in range(300)]
    ends = [(r.choice("ab"), r.randint(0, 15000), k) for k in range(25)]
    out = first_after(spark.createDataFrame(asks, "scope string, seq long, memory_id long"), spark.createDataFrame(ends, "scope string, seq long, mark long"), "scope").collect()
    want = {m: min((e for x, e, _ in ends if x == s and e > q), default=None) for s, q, m in asks}
    assert {x["memory_id"]: x["after"]["seq"] for x in out} == {m: e for m, e in want.items() if e is not None}


def test_numbered_over_ranges(spark):
    rows = spark.createDataFrame(made(4), "id int, key string, n int, v int").repartition(5)
    assert [r["rank"] for r in numbered(rows, "n", "id").orderBy("n", "id").collect()] == list(range(1, 201))
    assert numbered(rows.where(F.lit(False)), "n").count() == 0

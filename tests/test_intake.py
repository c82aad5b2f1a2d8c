"""Rules for requests, keyed tables and the index on disk, against plain Python."""

import datetime
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from annalist.functions import rules as R
from annalist.functions import text as T
from annalist.operators.lexical import bm25, top_each
from annalist.sources import postings
from annalist.sources.keyed import OFFER, KeyedTable


def judge(spark, kind, *values):
    rows = spark.createDataFrame([(kind, v if v is None or isinstance(v, str) else json.dumps(v), k) for k, v in enumerate(values)], "kind string, value string, k int")
    return [r["reasons"] for r in R.judged(rows).orderBy("k").collect()]


MESSAGE = {"role": "user", "content": "x", "timestamp": 5}
ADD = {"request_id": "r", "user_id": "u", "session_id": "s", "messages": [MESSAGE]}


def test_add_requests(spark):
    bad = [{"role": "user", "content": " \n"}, 5, {"content": "x", "timestamp": True}, {"role": "a", "content": "b", "timestamp": 1.5}]
    got = judge(spark, "add", ADD, ADD | {"user_id": " "}, ADD | {"messages": []}, ADD | {"messages": None}, ADD | {"messages": bad}, ADD | {"request_id": 7, "session_id": None}, "{broken", "[1]", None, ADD | {"messages": [MESSAGE | {"timestamp": None}]}, ADD | {"messages": [MESSAGE | {"timestamp": -1}]})
    assert got == [[], ["user_id"], ["messages"], ["messages"], ["message", "role", "content", "timestamp"], ["request_id", "session_id"], ["malformed"], ["malformed"], ["malformed"], [], ["timestamp"]]


def test_search_and_range_requests(spark):
    ok = {"query": "q", "user_id": "u", "top_k": 5}
    assert judge(spark, "search", ok, ok | {"top_k": True}, ok | {"top_k": 0}, ok | {"top_k": "5"}, ok | {"options": ["a", "b"]}, ok | {"options": ["a", 1]}, ok | {"options": {}}, {"top_k": 1}) == [[], ["top_k"], ["top_k"], ["top_k"], [], ["options"], ["options"], ["query", "user_id"]]
    day = "2024-01-02T00:00:00"
    assert judge(spark, "range", {}, {"limit": 0}, {"limit": True}, {"limit": -1}, {"since": day}, {"since": day + "Z", "until": day + "+00:01"}, {"since": day + "+00:01", "until": day + "Z"}) == [[], [], ["limit"], ["limit"], ["since"], ["time_order"], []]


def test_capture_claim_and_evidence_requests(spark):
    ok = {"content": "c"}
    assert judge(spark, "capture", ok, ok | {"tier": "testimony"}, ok | {"tier": "gold"}, ok | {"material_type": "song"}, ok | {"session_position": 0}, ok | {"session_position": 2**63 - 1, "session_id": "s"}, ok | {"session_position": 2**63, "session_id": "s"}, ok | {"origin_id": " "}) == [[], ["testimony"], ["tier"], ["material_type"], ["session_position"], [], ["session_position"], ["origin_id"]]
    assert judge(spark, "claim", {"content": "c", "reason": "r", "kind": "plan"}, {"content": "c", "reason": "r"}, {"content": "c", "reason": "r", "kind": "rumour"}) == [[], ["kind"], ["kind"]]
    assert judge(spark, "evidence", {"claim_id": "c", "memory_id": "m", "reason": "r", "stance": "context"}, {"claim_id": "c", "memory_id": "m", "reason": "r", "stance": "x", "quote": ""}) == [[], ["stance", "quote"]]
    assert judge(spark, "dance", {}) == [["unknown_kind"]]


def test_times_equal_python(spark):
    r = random.Random(1)
    shapes = ["{:04}-{:02}-{:02}T{:02}:{:02}:{:02}"]
    texts = ["0001-01-01T00:00:00+00:01", "9999-12-31T23:59:59-00:01", "2024-02-29T00:00:00Z", "2023-02-29T00:00:00Z", "2024-01-01", "2024-01-01T00:00Z", "", " 2024-01-01T00:00:00Z"]
    for _ in range(300):
        t = r.choice(shapes).format(r.choice([1, 1969, 2024, 9999]), r.randint(0, 13), r.randint(0, 32), r.randint(0, 25), r.randint(0, 61), r.randint(0, 61))
        texts.append(t + r.choice(["", ".5", ".123456", ".1234567"]) + r.choice(["Z", "+05:30", "-23:59", "+24:00", "+00:60", ""]))

    def python(t):
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})", t):
            return None
        try:
            at = datetime.datetime.fromisoformat(t.replace("Z", "+00:00")).astimezone(datetime.UTC)
        except (ValueError, OverflowError):
            return None
        return (at - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) // datetime.timedelta(microseconds=1)

    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", "t", F.unix_micros(R.iso_time(F.col("t"))).alias("m")).collect()
    assert {x["t"]: x["m"] for x in got} == {t: python(t) for t in texts}


def test_split_is_one_table(spark, tmp_path):
    rows = spark.createDataFrame([("add", json.dumps(ADD), 1), ("add", "{", 2), ("search", "{}", 3)], "kind string, value string, k int")
    good, bad = R.split(rows, str(tmp_path / "t"))
    assert [r["k"] for r in good.collect()] == [1] and sorted((r["k"], r["reasons"][0]) for r in bad.collect()) == [(2, "malformed"), (3, "query")]


def test_upserts_equal_a_dictionary(spark, tmp_path):
    """Puts and offers in order, replays, compactions anywhere, columns that come and go, null keys."""
    r = random.Random(7)
    table, want, sent = KeyedTable(spark, str(tmp_path / "t"), ("a", "b"), buckets=3), {}, []
    for number in range(1, 8):
        kind = r.choice(["put", "offer"])
        names = ["a", "b", "x", "o"] if number % 3 else ["a", "b", "x", "y", "o"]
        rows = [tuple({"a": r.choice([None, 1, 2]), "b": r.choice("pq"), "x": r.randint(0, 99), "y": r.randint(0, 9), "o": k}[n] for n in names) for k in range(r.randint(0, 4) if number != 3 else 0)]
        schema = ", ".join(f"{n} {'string' if n == 'b' else 'int'}" for n in names)
        sent.append((rows, schema, number, kind))
        table.write(spark.createDataFrame(rows, schema), number, "o", kind)
        for row in map(dict, (zip(names, x, strict=True) for x in rows)):
            key = (row["a"], row["b"])
            if kind == "put" or key not in want:
                want[key] = {"x": row["x"], "y": row.get("y"), "o": row["o"]}
            # a put replaces what was offered, an offer only fills a gap
        if number in (2, 5):
            table.compact()
        if number in (4, 6):  # a batch comes again
            rows, schema, n, kind = r.choice(sent)
            if n == number:
                table.write(spark.createDataFrame(rows, schema), n, "o", kind)
    got = {(x["a"], x["b"]): {"x": x["x"], "y": x.asDict().get("y"), "o": x["o"]} for x in table.read().collect()}
    assert got == want and got


def test_lookup_reads_the_keys_folders_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ("k",), buckets=8)
    table.write(spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("v")), 1, "v")
    found = table.lookup(spark.createDataFrame([(5,), (5,), (1000,)], "k long"))
    assert [tuple(x) for x in found.collect()] == [(5, 5)]
    assert all("_bucket=" in f for f in found.inputFiles())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket", plan)
    with pytest.raises(ValueError, match="put or offer"):
        table.write(spark.range(1).withColumnRenamed("id", "k"), 2, "k", "maybe")


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(5)
    words = [f"w{int(r.paretovariate(0.7)) % 400}" for _ in range(4000)]
    rows = [(k, " ".join(r.choices(words, k=r.randint(0, 30))) if k % 50 else None) for k in range(3000)]
    return spark.createDataFrame(rows, "id long, content string").repartition(5)


@pytest.mark.parametrize("parts", [1, 3])
def test_index_equals_scores_of_all(spark, tmp_path, texts, parts):
    path = str(tmp_path / "index")
    for k in range(parts):
        postings.add(texts.where(F.col("id") % parts == k), path, str(k))
        postings.add(texts.where(F.col("id") % parts == k), path, str(k))  # once more: it replaces itself
    queries = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w57 w57 w91"), (3, "nothing here"), (4, ""), (5, " ".join(f"w{k}" for k in range(100)))], "qid long, query string")
    scores = bm25(texts.withColumn("content", F.coalesce("content", F.lit(""))), queries)
    want = top_each(scores, "qid", 7, F.desc("relevance"), "id").select("qid", "rank", "id", "relevance")
    assert sorted(map(tuple, postings.search(spark, path, queries, 7).collect())) == sorted(map(tuple, want.collect()))
    plan = postings.search(spark, path, queries.where("qid = 2"), 7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_token_caches(spark):
    rows = [("a b cc", '["x", "y"]'), ("dd", '["x", 1]'), ("ee", "[]"), ("ff", "[null]"), ("gg", "{"), ("hh", None), ("中ab文", '["x"]'), ("ii", '"jj"'), ("kk", '{"a": "b"}')]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, content string, c string").select("k", postings.cached_tokens(F.col("content"), F.col("c")).alias("t"), T.tokens(F.col("content")).alias("own")).orderBy("k").collect()
    assert [r["t"] for r in got] == [["x", "y"], ["dd"], [], ["ff"], ["gg"], ["hh"], got[6]["own"], ["ii"], ["kk"]] and got[6]["own"] != ["x"]


def test_requests_are_parsed_once(spark):
    """Each rule's look at a request parsed it anew."""
    rows = R.judged(spark.createDataFrame([("add", "{}")], "kind string, value string"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1

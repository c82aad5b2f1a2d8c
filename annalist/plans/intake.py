"""Queries of what comes in: requests against rules, times in strict and lenient form, upserts with replays and compaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import paths as P
from annalist.functions import rules as R
from annalist.functions import vocab as V
from annalist.plans.relations import STATED, stated
from annalist.sources import dialogues
from annalist.sources import model as M
from annalist.sources.keyed import OFFER, KeyedTable
from annalist.sources.store import shared_path


def piece(column, *cases, otherwise):
    """A stretch of JSON text by the remainder of an id."""
    out = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    for k, text in cases:
        out = F.when(column == k, F.lit(text) if isinstance(text, str) else text).otherwise(out)
    return out


def requests(spark, sf):
    """Add requests from turns, searches from events, claims and time ranges from orders, in JSON text, some of them wrong."""
    s = stated(spark, sf).select("id", F.pmod("id", F.lit(11)).alias("k"), F.to_json(F.struct("content")).alias("c"))
    content = F.expr("substring(c, 2, length(c) - 2)")
    message = F.concat(F.lit('{"role": '), piece(F.col("k"), (8, "null"), otherwise='"user"'), F.lit(", "), content, F.lit(', "timestamp": '), piece(F.col("k"), (4, "-5"), (7, "true"), (9, "null"), otherwise="1704067200000"), F.lit("}"))
    add = F.concat(F.lit('{"request_id": '), piece(F.col("k"), (6, "6"), otherwise='"r"'), F.lit(', "user_id": '), piece(F.col("k"), (1, '" "'), otherwise='"u"'), F.lit(', "session_id": "s", "messages": ['), F.when(F.col("k") == 2, "").otherwise(message), F.when(F.col("k") == 5, "").otherwise("]}"))
    adds = s.select(F.lit("add").alias("kind"), "id", add.alias("value"))

    e = M.table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    top_k = piece(F.col("id") % 7, (0, "true"), (1, "5.0"), (2, "0"), (3, '"5"'), otherwise=(F.col("id") % 50 + 1).cast("string"))
    options = piece(F.col("id") % 5, (0, ', "options": [1]'), (1, ', "options": "x"'), (2, ', "options": ["a"]'), (3, ', "options": null'), otherwise="")
    searches = e.select(F.lit("search").alias("kind"), "id", F.concat(F.lit('{"query": "'), "event_type", F.lit('", "user_id": "u", "top_k": '), top_k, options, F.lit("}")).alias("value"))

    o = M.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    until = F.date_add("day", (F.col("id") % 5 - 2).cast("int"))
    kinds = F.element_at(F.array(*map(F.lit, [*V.CLAIM_KINDS, "rumour", "PLAN"])), (F.col("id") % 8 + 1).cast("int"))
    said = piece(F.col("id") % 6, (0, F.concat(F.lit('"'), F.col("day").cast("string"), F.lit('"'))), (1, '"2024-02-30T00:00:00Z"'), (2, '"2024-02-29T10:00:00.25+05:30"'), (3, "17"), otherwise="null")
    claims = o.select(F.lit("claim").alias("kind"), "id", F.concat(F.lit('{"content": "c", "reason": "because", "kind": "'), kinds, F.lit('", "valid_from": "'), F.col("day").cast("string"), F.lit('T00:00:00Z", "valid_until": "'), until.cast("string"), F.lit('T00:00:00Z", "statement_at": '), said, F.lit("}")).alias("value"))
    offset = piece(F.col("id") % 3, (0, "+01:00"), (1, "Z"), otherwise="-01:00")
    ranges = o.select(F.lit("range").alias("kind"), "id", F.concat(F.lit('{"limit": '), (F.col("id") % 9 - 2).cast("string"), F.lit(', "since": "'), F.col("day").cast("string"), F.lit('T12:00:00Z", "until": "'), F.col("day").cast("string"), F.lit("T12:00:00"), offset, F.lit('"}')).alias("value"))
    return adds.unionByName(searches).unionByName(claims).unionByName(ranges)


def requests_judged(spark, sf):
    """Everything that is wrong with every request, in the order of the rules."""
    return R.judged(requests(spark, sf)).select("kind", "id", F.array_join("reasons", ",").alias("reasons"))


def requests_split(spark, sf):
    """Accepted and rejected requests, written in one pass: how many of each kind, by first reason."""
    accepted, rejected = R.split(requests(spark, sf), shared_path(spark, "intake"))
    rows = accepted.select("kind", F.lit("").alias("reason")).unionByName(rejected.select("kind", F.get("reasons", 0).alias("reason")))
    return rows.groupBy("kind", "reason").agg(F.count("*").alias("n"))


def times_parsed(spark, sf):
    """Times of events in eight forms: strictly (zone needed) and leniently read."""
    e = M.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 8).alias("k"))
    local = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    form = piece(F.col("k"), (0, F.concat(local, F.lit("Z"))), (1, F.concat(local, F.lit("+05:30"))), (2, local), (3, F.date_format("ts", "yyyy-MM-dd")), (4, F.concat(local, F.lit(".5-00:15"))), (5, F.unix_timestamp("ts").cast("string")), (6, "soon"), otherwise=F.lit(None).cast("string"))
    return e.select("event_id", form.alias("t")).select("event_id", F.unix_micros(R.iso_time(F.col("t"))).alias("strict"), R.epoch(F.col("t")).alias("lenient"))


def profiles(spark, sf):
    """A table of users, upserted from events: two batches are put, two only offered; one brings a column more; between them the
    table is compacted, and batches come again."""
    e = M.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    table = KeyedTable(spark, shared_path(spark, "profiles"), ("user_id",))
    batch = lambda k: e.where(F.col("event_id") % 4 == k)
    table.write(batch(0).where("event_id % 3 = 0"), 1, "event_id")
    table.write(batch(1), 2, "event_id", OFFER)
    table.compact()
    table.write(batch(1), 2, "event_id", OFFER)
    for _ in range(2):
        table.write(batch(2).where("event_id % 5 = 0").withColumn("label", F.concat(F.lit("l"), "event_id")), 3, "event_id")
    table.write(batch(3), 4, "event_id", OFFER)
    return table


def profiles_upserted(spark, sf):
    return profiles(spark, sf).read().select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"), "label")


def profiles_looked_up(spark, sf):
    """The rows of users with an error, from their folders."""
    wanted = M.table(spark, sf, "events").where("event_type = 'error'").select("user_id").distinct()
    return profiles(spark, sf).lookup(wanted).select("user_id", "event_id", "label")


#: What is read of every Add request, in one scan.
PATHS = {"roles": "messages.*.role", "times": "messages.*.timestamp", "first_role": "messages.0.role", "second": "messages.1", "who": "user_id", "request": "request_id", "nothing": "messages.*.colour"}


def request_paths(spark, sf):
    rows = requests(spark, sf).where("kind = 'add'")
    return rows.select("id", *P.read(F.col("value"), PATHS))


def dialogue_lines(spark, sf):
    """Conversations as dialogue files: five to a file, a session each, questions on them; some files are wrong."""
    t = M.turns(spark, sf).withColumns({"file": F.floor(F.col("session_id") / 5), "n": F.col("session_id") % 5 * 3 + 1})
    turn = F.struct(F.concat_ws(":", F.concat(F.lit("D"), "n"), "position").alias("dia_id"), F.col("source").alias("speaker"), F.col("content").alias("text"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("picture "), "id")).alias("blip_caption"))
    sessions = t.groupBy("file", "n").agg(F.sort_array(F.collect_list(F.struct("position", turn.alias("turn")))).alias("s"), F.max("position").alias("last"))
    sessions = sessions.select("file", "n", "last", F.to_json("s.turn").alias("json"))
    files = sessions.groupBy("file").agg(F.array_join(F.transform(F.collect_list(F.struct("n", "json")), lambda x: F.concat(F.lit('"session_'), x["n"], F.lit('": '), x["json"], F.lit(', "session_'), x["n"], F.lit('_date": "x"'))), ", ").alias("sessions"), F.sort_array(F.collect_list(F.struct("n", "last"))).alias("ends"))

    def question(x, k):
        gold = F.concat(F.lit('"D'), x["n"], F.lit(":"), x["last"], F.lit('"'))
        evidence = F.when(k % 4 == 0, F.concat(gold, F.lit(", "), F.lit('" D1:0 "'), F.lit(', "D1:0"'))).when(k % 4 == 1, F.lit("")).when(k % 4 == 2, F.lit('"D99:0"')).otherwise(gold)
        return F.concat(F.lit('{"question": "what of '), x["n"], F.lit('?", "category": '), (x["n"] % 5 + 1).cast("string"), F.lit(', "evidence": ['), evidence, F.lit("]}"))

    qa = F.array_join(F.transform("ends", question), ", ")
    wrong = piece(F.col("file") % 9, (4, '[{"question": " ", "category": 1}]'), (7, "[]"), otherwise=F.concat(F.lit("["), qa, F.lit("]")))
    return files.select("file", F.concat(F.lit('{"sample_id": "f'), F.col("file"), F.lit('", "conversation": {"speaker_a": "x", '), "sessions", F.lit('}, "qa": '), wrong, F.lit("}")).alias("value"))


def dialogue_documents(spark, sf):
    documents, _, _ = dialogues.imported(dialogue_lines(spark, sf))
    return documents.select("conversation", "session", "position", "id", F.md5("text").alias("text_md5"))


def dialogue_questions(spark, sf):
    """Questions by what excludes them, with their evidence; files that are wrong by reason."""
    _, questions, wrong = dialogues.imported(dialogue_lines(spark, sf))
    rows = questions.select("conversation", "number", "category", F.array_join("gold", ",").alias("gold"), F.coalesce("excluded", F.lit("")).alias("excluded"))
    return rows.unionByName(wrong.select("conversation", F.lit(-1).alias("number"), F.lit(None).cast("int").alias("category"), F.lit("").alias("gold"), F.col("reason").alias("excluded")))


QUERIES = {f.__name__: f for f in (requests_judged, requests_split, times_parsed, profiles_upserted, profiles_looked_up, request_paths, dialogue_documents, dialogue_questions)}

# What is wrong is said by hand here, for each remainder.
JUDGED = rf"""a as (select 'add' as kind, id, ((id % 11) + 11) % 11 as k, not regexp_matches(content, '[^\s\p{{Z}}]') as blank from stated),
j as (
  select kind, id, case when k = 5 then 'malformed' else concat_ws(',', case when k = 6 then 'request_id' end, case when k = 1 then 'user_id' end, case when k = 2 then 'messages' end, case when k = 8 then 'role' end, case when blank and k <> 2 then 'content' end, case when k in (4, 7) then 'timestamp' end) end as reasons from a
  union all select 'search', event_id, concat_ws(',', case when event_id % 7 < 4 then 'top_k' end, case when event_id % 5 < 2 then 'options' end) from events
  union all select 'claim', o_orderkey, concat_ws(',', case when o_orderkey % 8 > 5 then 'kind' end, case when o_orderkey % 6 in (0, 1, 3) then 'statement_at' end, case when o_orderkey % 5 < 2 then 'valid_order' end) from orders
  union all select 'range', o_orderkey, concat_ws(',', case when o_orderkey % 9 < 2 then 'limit' end, case when o_orderkey % 3 = 0 then 'time_order' end) from orders)"""
DIALOGUES = f"{M.TURNS}, d as (select *, session_id // 5 as file, 'f' || (session_id // 5) as conversation, session_id % 5 * 3 + 1 as n, 'D' || (session_id % 5 * 3 + 1) || ':' || position as dia from turns)"
UPSERTED = """p as (
  select *, 'l' || event_id as l, event_id % 4 = 0 as first from events where (event_id % 4 = 0 and event_id % 3 = 0) or (event_id % 4 = 2 and event_id % 5 = 0)
  qualify row_number() over (partition by user_id order by event_id % 4 desc, event_id desc) = 1),
o as (select * from events where event_id % 4 in (1, 3) and user_id not in (select user_id from p) qualify row_number() over (partition by user_id order by event_id % 4, event_id) = 1),
up as (select user_id, event_id, event_type, round(value, 6) as value, case when not first then l end as label from p union all select user_id, event_id, event_type, round(value, 6), null from o)"""
ORACLE = {
    "requests_judged": f"with {STATED}, {JUDGED} select * from j",
    "request_paths": f"""with {STATED}, a as (select id, ((id % 11) + 11) % 11 as k from stated), r as (select id, k, case when k = 8 then 'null' else '"user"' end as role, case k when 4 then '-5' when 7 then 'true' when 9 then 'null' else '1704067200000' end as ts from a)
select id, case when k = 2 then '[]' when k <> 5 then '[' || role || ']' end as roles, case when k = 2 then '[]' when k <> 5 then '[' || ts || ']' end as times, case when k not in (2, 5) then role end as first_role, null::varchar as second,
  case when k = 1 then '" "' when k <> 5 then '"u"' end as who, case when k = 6 then '6' when k <> 5 then '"r"' end as request, case when k = 2 then '[]' end as nothing from r""",
    "dialogue_documents": f"with {DIALOGUES} select conversation, n as session, position::int as position, dia as id, md5(source || ': ' || content || case when id % 4 = 0 then chr(10) || 'Image caption: picture ' || id else '' end) as text_md5 from d where file % 9 not in (4, 7)",
    "dialogue_questions": f"""with {DIALOGUES}, e as (select file, conversation, n, max(position) as last, row_number() over (partition by file order by n) - 1 as number from d group by file, conversation, n),
q as (select conversation, number::int as number, (n % 5 + 1)::int as category, case number % 4 when 0 then case when 'D' || n || ':' || last = 'D1:0' then 'D1:0' else 'D' || n || ':' || last || ',D1:0' end when 1 then '' when 2 then 'D99:0' else 'D' || n || ':' || last end as gold, file,
  case when n % 5 = 4 then 'adversarial' when number % 4 = 1 then 'no_evidence' when number % 4 = 2 or (number % 4 = 0 and not exists (select 1 from d where d.file = e.file and dia = 'D1:0')) then 'unresolved_evidence' else '' end as excluded from e)
select conversation, number, category, gold, excluded from q where file % 9 not in (4, 7) union all select distinct conversation, -1, null, '', case file % 9 when 4 then 'question' else 'empty' end from d where file % 9 in (4, 7)""",
    "requests_split": f"with {STATED}, {JUDGED} select kind, string_split(reasons, ',')[1] as reason, count(*) as n from j group by all",
    "times_parsed": """with e as (select event_id, event_id % 8 as k, floor(epoch(ts))::bigint as s, floor(epoch(date_trunc('day', ts)))::bigint as d from events)
select event_id, case k when 0 then s * 1000000 when 1 then (s - 19800) * 1000000 when 4 then (s + 900) * 1000000 + 500000 end as strict, (case k when 0 then s when 1 then s - 19800 when 2 then s when 3 then d when 4 then s + 900.5 when 5 then s end)::double as lenient from e""",
    "profiles_upserted": f"with {UPSERTED} select * from up",
    "profiles_looked_up": f"with {UPSERTED} select user_id, event_id, label from up where user_id in (select user_id from events where event_type = 'error')",
}

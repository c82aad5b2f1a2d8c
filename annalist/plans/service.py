"""Queries of the batch search over all conversations and the phrases: its stages and the whole."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from annalist.functions import question as Q
from annalist.functions import text as T
from annalist.operators import search as S
from annalist.operators.governance import contradictions, versions
from annalist.plans import relations as R
from annalist.plans import texts as X
from annalist.plans.retrieval import bm25_sql, tok
from annalist.sources import model as M
from annalist.sources.store import kept

NOW = M.EPOCH + 400 * 3600
ASKED = [
    (1, "where does she live in london", 8),
    (2, "what happened to the bank in 2020", 8),
    (3, "can she lock the door, what is the rule", 8),
    (4, "what does she like", 8),
    (5, "she moved to the bank yesterday", 8),
    (6, "timeline of spicy noodles in order", 8),
    (7, "why did he quit the bank", 8),
    (8, "thing ther that than oner", 15),
    (9, "den schen que between 2019 and 2023", 10),
]


def rows(spark, sf):
    """Turns and phrases as one store; two anchors, one canon entry, rules marked."""
    section = F.when(F.col("id").isin(5000, -30), "anchor").when(F.col("id") == 7001, "canon").otherwise("ordinary")
    return R.stated(spark, sf).withColumns({"section": section, "rule": T.is_rule(F.col("content"))})


def asked(spark):
    return S.requests(spark, ASKED, NOW)


def search_sections(spark, sf):
    return S.sections(rows(spark, sf), asked(spark)).select("qid", "id", "place", F.round("score", 4).alias("score"))


def search_neighbours(spark, sf):
    r, a = rows(spark, sf), asked(spark)
    return S.neighbours(r, a, S.sections(r, a))


def recorded(spark, sf):
    """What was found when rows came: versions, contradictions and summaries, as tables."""
    source, r = f"{sf}/conversations.parquet", rows(spark, sf)
    return kept(spark, "versions", source, lambda: versions(r, "session_id")), kept(spark, "contradictions", source, lambda: contradictions(r, "session_id")), kept(spark, "summaries", source, lambda: S.summaries(r))


def search_governed(spark, sf):
    return S.evidence(rows(spark, sf), asked(spark), recorded(spark, sf)[0]).select("qid", "id", "place", "score")


def search_service(spark, sf):
    return S.searched(rows(spark, sf), asked(spark), *recorded(spark, sf))


def clue_weights(spark, sf):
    """How many turns lie inside each question's time windows."""
    w = asked(spark).where(F.size("windows") > 0).select("qid", "windows")
    t = M.turns(spark, sf).select("moment")
    newest = t.agg(F.max("moment").alias("now"))
    factor = Q.weight(F.col("moment").cast("double"), F.col("now").cast("double"), F.col("windows"))
    return t.join(F.broadcast(newest)).join(F.broadcast(w)).groupBy("qid").agg(F.count_if(factor > 1).alias("inside"), F.count("*").alias("n"))


def session_summaries(spark, sf):
    """The four newest sessions' running summaries, by an id of their session."""
    s = S.summaries(M.turns(spark, sf)).orderBy(F.desc("latest"), "session_id").limit(4)
    return s.select(F.substring(F.sha2(F.col("session_id").cast("string"), 256), 1, 10).alias("key"), "latest")


def contract_rows(spark, sf):
    """Entries as the contract has them: text id, score if there is one, time in UTC with a Z."""
    e = S.sections(rows(spark, sf), asked(spark)).join(rows(spark, sf).select("id", "moment"), "id")
    return e.select("qid", F.col("id").cast("string").alias("id"), F.round("score", 4).alias("score"), F.date_format(F.timestamp_seconds("moment"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))


QUERIES = {f.__name__: f for f in (search_sections, search_neighbours, search_governed, search_service, clue_weights, session_summaries, contract_rows)}

# What each question asks for, worked out by hand: further words, intents, one window (centre or seconds back, half), years.
BY_HAND = """asked as (select * from (values
  (1, 'where does she live in london', 'where does she live in london lived reside stay residing moved relocated lives', 8, false, false, false, false, false, false, false, null::double, null::double, null::double, []::int[]),
  (2, 'what happened to the bank in 2020', 'what happened to the bank in 2020', 8, true, false, false, true, false, false, false, 1577836800, null, 15552000, [2020]),
  (3, 'can she lock the door, what is the rule', 'can she lock the door, what is the rule', 8, false, true, true, false, false, false, false, null, null, null, []),
  (4, 'what does she like', 'what does she like love prefer favorite enjoy', 8, false, false, false, false, false, true, false, null, null, null, []),
  (5, 'she moved to the bank yesterday', 'she moved to the bank yesterday', 8, false, false, false, false, false, false, true, null, 86400, 43200, []),
  (6, 'timeline of spicy noodles in order', 'timeline of spicy noodles in order', 8, false, false, false, false, true, false, false, null, null, null, []),
  (7, 'why did he quit the bank', 'why did he quit the bank', 8, false, false, false, true, false, false, false, null, null, null, []),
  (8, 'thing ther that than oner', 'thing ther that than oner', 15, false, false, false, false, false, false, false, null, null, null, []),
  (9, 'den schen que between 2019 and 2023', 'den schen que between 2019 and 2023', 10, false, false, false, false, false, false, false, 1609459200, null, 78840000, [2019, 2023])
) v(qid, query, expanded, top_k, f_summary, f_rule, f_answer, f_causal, f_order, f_pref, f_recent, centre, back, half, yrs))"""
INDICATORS = "['不能', '不可以', '不行', '不许', '不准', '禁止', '不允许', 'never', 'always', 'don''t', 'do not', 'must not', 'forbidden', 'prohibited', 'not allowed', '忌', '讲究', '注意', '小心']"
YEARS = r"list_transform(regexp_extract_all(content, '(20\d\d)年|(?i:in|during) (?i:the year )?(20\d\d)'), lambda x: regexp_extract(x, '(20\d\d)', 1)::int)"
STORE = f"{R.STATED}, {BY_HAND}, store as (select *, case when id in (5000, -30) then 'anchor' when id = 7001 then 'canon' else 'ordinary' end as section, (regexp_matches(content, {X.q(X.V.RULE_PARTS)}) or {X.has('content', X.V.RULE_WORDS)}) as rule from stated)"
SECTIONS = f"""{STORE}, plain as (select * from store where section = 'ordinary'), qx as (select qid, expanded as query from asked), {bm25_sql('plain', 'qx')},
cn as (select count(*) filter (where section = 'anchor') as na, count(*) filter (where section = 'canon') as nc from store),
lim as (select asked.qid, top_k, na, nc, greatest(top_k - na, 0) - least(nc, greatest(top_k - na, 0)) as rest from asked, cn),
fx as (select id, section, row_number() over (partition by section order by moment, id) as n from store where section <> 'ordinary'),
sec as (select qid, id, section, case when section = 'anchor' then n else na + n end as place, null::double as score from fx, lim where section = 'anchor' or n <= greatest(top_k - na, 0)
  union all select qid, id, 'ordinary', na + nc + n, relevance from (select scores.qid, scores.id, relevance, row_number() over (partition by scores.qid order by relevance desc, moment desc, scores.id) as n from scores join store on store.id = scores.id where relevance > 0) join lim using (qid) where n <= rest)"""
NEAR = f"""{SECTIONS}, seed as (select sec.qid, store.id, session_id, position, list_distinct({tok('content')}) as words from sec join store on store.id = sec.id where sec.section <> 'canon'),
sg as (select asked.qid, f_causal, top_k - count(*) as room, list_distinct(list_concat(flatten(list(words)), any_value({tok('expanded')}))) as signal from seed join asked using (qid) group by asked.qid, f_causal, top_k),
nx as (select distinct seed.qid, t.id, t.session_id, t.position, list_distinct({tok('t.content')}) as words from seed join sg using (qid) join store t on t.session_id = seed.session_id and abs(t.position - seed.position) <= case when f_causal then 5 else 3 end where not exists (select 1 from sec where sec.qid = seed.qid and sec.id = t.id)),
nh as (select nx.qid, id, session_id, position, room, case when f_causal then least(len(words), 1) else len(list_intersect(words, signal)) end as hits from nx join sg using (qid)),
nb as (select qid, id, 1000000 + n as place, round(hits * 0.01::double, 4) as score from (select *, row_number() over (partition by qid order by session_id, position, id) as n from nh where hits > 0) where n <= room)"""


def renamed(sql: str) -> str:
    """The chain of CTEs for pairs under other names, for a second use."""
    return re.sub(r"\b(placed|pr|p0|pp|pq)\b", r"g_\1", sql)


GOVERNED = f"""{NEAR}, base as (select b.qid, b.place, b.score, store.* from (select qid, id, place, score from sec union all select * from nb) b join store on store.id = b.id),
tm as (select base.* exclude (score), round(score * case when half is not null and len(list_intersect({YEARS}, yrs)) > 0 then 1.5::double else 1::double end, 4) as s1, half, case when half is null then 1::double when abs(moment - coalesce(centre, max(moment) over (partition by base.qid) - back)) <= half then 1.25::double else 0.8::double end as f from base join asked using (qid)),
ent as (select *, round(s1 * f, 4) as score from tm),
kept as (select * from ent qualify row_number() over (partition by qid, {X.normal('content')} order by moment desc, position desc, id desc) = 1), {R.near_sql('stated', 'session_id')}, ver as (select distinct old_id from ({R.VERSIONS})), {R.CONTRA},
{renamed(R.near_sql('(select * exclude (place) from kept)', 'qid').replace('len(list_intersect(o.tk, n.tk)) as sh', 'o.qid as qid, len(list_intersect(o.tk, n.tk)) as sh'))},
wg as (select qid, o_id as id, max(j) as j, max(cv) as c from g_pq where o_source = n_source and (sd or rw) group by 1, 2),
gv as (select k.qid, k.id, k.content, k.moment, k.place, case when ver.old_id is not null and k.half is null then round(s * 0.1::double, 4) else s end as score from (select kept.*, round(kept.score * case when j > 0 or c > 0 then case when j >= 0.6 or c >= 0.75 then 0.25::double else 0.5::double end else 1::double end, 4) as s from kept left join wg on wg.qid = kept.qid and wg.id = kept.id) k left join ver on ver.old_id = k.id),
mn as (select qid, id, content, moment, score, row_number() over (partition by qid order by (score is not null)::int, score desc, place)::int as place from gv)"""
FINAL = f"""{GOVERNED}, o1 as (select qid, id::varchar as entry, content, moment, score, 2 as grp, place from mn
  union all select qid, 'summary_' || left(sha256(session_id::varchar), 10), '', null, 999, 0, n from (select session_id, row_number() over (order by max(moment) desc, 'summary_' || left(sha256(session_id::varchar), 10)) as n from store group by session_id having bool_or(length(trim(content)) > 0)) join asked on f_summary and n <= greatest(1, least(4, top_k // 4))
  union all select qid, id::varchar, content, moment, 999, 1, n from (select *, row_number() over (order by moment desc, position desc, id desc) as n from store where rule) join asked on f_rule and n <= least(top_k, 12)),
o2 as (select o1.* replace (case when f_answer and score is not null and len(list_filter({INDICATORS}, lambda x: contains(lower(content), x))) > 0 then greatest(score, 0.9::double) else score end as score) from o1 join asked using (qid)),
nw as (select *, row_number() over (order by moment desc, id desc) as n from store),
o3 as (select * from o2 union all select qid, id::varchar, content, moment, 0.6::double, 3, n from nw join asked on f_pref and n <= 200 where {X.domain('content')} = 'preference' and not exists (select 1 from o2 where o2.qid = asked.qid and o2.entry = nw.id::varchar)),
o4 as (select * from o3 union all select qid, id::varchar, content, moment, 0.7::double, 4, n from nw join asked on f_recent and n <= top_k where not exists (select 1 from o3 where o3.qid = asked.qid and o3.entry = nw.id::varchar)),
o5 as (select o4.* replace (case when f_recent and score is not null and row_number() over (partition by o4.qid, score is not null order by coalesce(moment, 0) desc, grp, place) <= greatest(1, floor(count(*) over (partition by o4.qid, score is not null) * 0.3)) then least(score + 0.15::double, 1::double) else score end as score) from o4 join asked using (qid)),
pt as (select distinct o5.qid, other from o5 join (select a::varchar as entry, b as other from ct where signal is not null union select b::varchar, a from ct where signal is not null) using (entry)),
o6 as (select * from o5 union all select pt.qid, other::varchar, content, moment, 0.5::double, 5, other from pt join store on store.id = other where not exists (select 1 from o5 where o5.qid = pt.qid and o5.entry = pt.other::varchar)),
o7 as (select * from o6 qualify row_number() over (partition by qid, entry order by (score is not null)::int, score desc, grp, place) = 1)
select qid, rank::int as rank, entry, round(score, 4) as score from (select o7.*, top_k, row_number() over (partition by o7.qid order by (score is not null)::int, case when f_order and score is not null then coalesce(moment, 0) else 0 end, case when f_order then 0 else score end desc, grp, place, entry) as rank from o7 join asked using (qid)) where rank <= top_k"""
ORACLE = {
    "search_sections": f"with {SECTIONS} select qid, id, place::int as place, score from sec",
    "search_neighbours": f"with {NEAR} select qid, id, place::int as place, score from nb",
    "search_governed": f"with {GOVERNED} select qid, id, place, score from mn",
    "search_service": f"with {FINAL}",
    "clue_weights": f"with {M.TURNS}, {BY_HAND} select qid, count(*) filter (where abs(moment - coalesce(centre, (select max(moment) from turns) - back)) <= half) as inside, count(*) as n from turns, asked where half is not null group by qid",
    "session_summaries": f"with {M.TURNS} select left(sha256(session_id::varchar), 10) as key, max(moment) as latest from turns group by session_id order by latest desc, session_id limit 4",
    "contract_rows": f"with {SECTIONS} select qid, sec.id::varchar as id, score, strftime(make_timestamp(moment * 1000000), '%Y-%m-%dT%H:%M:%SZ') as created_at from sec join store on store.id = sec.id",
}

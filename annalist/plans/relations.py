"""Queries of joins over sessions and links, governance of statements, temporal weights and the composed search."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.functions import vocab as V
from annalist.operators.expand import band, expand, links_both
from annalist.operators.governance import contradictions, governed, versions
from annalist.operators.lexical import bm25, top, top_each
from annalist.plans import texts as X
from annalist.plans.retrieval import QUERY, bm25_sql, tok
from annalist.sources import model as M
from annalist.sources.phrases import phrases, phrases_sql


def neighbour_band_join(spark, sf):
    t = M.turns(spark, sf)
    return band(t, t, 3)


def causal_band_join(spark, sf):
    t = M.turns(spark, sf)
    return band(t.where("source = 'system'"), t, 5)


def session_adjacent(spark, sf):
    t = M.turns(spark, sf)
    return band(t.where("position = 2"), t, 1)


def links(spark, sf):
    """Each first turn is linked to that of the next session, every third link explains."""
    t = M.turns(spark, sf).where("position = 0")
    nxt = t.select((F.col("session_id") - 1).alias("session_id"), F.col("id").alias("to_id"))
    return t.join(nxt, "session_id").select(F.col("id").alias("from_id"), "to_id", F.when(F.col("session_id") % 3 == 0, "explains").otherwise("related").alias("relation"))


def link_expand(spark, sf):
    user = M.turns(spark, sf).where("source = 'user'").select("id")
    both = links_both(links(spark, sf))
    return both.join(user.withColumnRenamed("id", "from_id"), "from_id").join(user.withColumnRenamed("id", "to_id"), "to_id").select("from_id", "to_id", "relation")


def history_expand(spark, sf):
    """Ranked turns of several queries, expanded by links and session neighbours."""
    t = M.turns(spark, sf)
    asked = M.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    ranked = top_each(bm25(M.tokens(spark, sf, "turns"), asked), "qid", 60, F.desc("relevance"), "id").join(t.select("id", "session_id", "position"), "id").select("qid", "id", "rank", "session_id", "position")
    return expand(ranked, links(spark, sf), 10)


def said(spark):
    return phrases(spark).withColumn("moment", F.col("session_id") * 100 + F.col("position")).withColumn("user", F.lit(1))


def version_edges_sessions(spark, sf):
    return versions(stated(spark, sf), "session_id")


def partners(pairs):
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where("a % 2 = 0 and b % 2 <> 0").select(F.col("b").alias("id")).distinct().withColumn("score", F.lit(0.5))


def stated(spark, sf):
    """All conversation turns and the phrases, whose ids and sessions are negative."""
    return M.turns(spark, sf).unionByName(said(spark).drop("user").withColumns({"id": -F.col("id"), "session_id": -F.col("session_id")}))


def contradiction_pairs_sessions(spark, sf):
    return contradictions(stated(spark, sf), "session_id")


def contradiction_partners_sessions(spark, sf):
    """Of every contradiction with one shown side (even ids), the other."""
    return partners(contradiction_pairs_sessions(spark, sf))


def govern_window_sessions(spark, sf):
    """Every session is a window of results, earlier turns first."""
    rows = stated(spark, sf).select(F.col("session_id").alias("qid"), "id", "source", "content", "moment", "position", F.round(1.0 / (F.col("position") + 1), 4).alias("score"))
    return governed(rows).select("qid", "id", "score")


CENTRE, HALF = M.EPOCH + 50 * 3600, 12 * 3600


def temporal_weight(spark, sf):
    return M.turns(spark, sf).select("id", F.when(F.abs(F.col("moment") - CENTRE) <= HALF, V.INSIDE).otherwise(V.OUTSIDE).alias("weight"))


def recency_boost(spark, sf):
    """The newest three tenths of a query's twenty hits gain 0.15, up to 1."""
    t = M.turns(spark, sf)
    asked = M.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    hits = top_each(bm25(M.tokens(spark, sf, "turns"), asked), "qid", 20, F.desc("relevance"), "id").join(t.select("id", "moment"), "id")
    newest = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("moment"), "id"))
    n = F.greatest(F.lit(1), F.floor(F.count("*").over(W.partitionBy("qid")) * 0.3))
    score = F.round(F.col("relevance") / 100, 6)
    return hits.withColumn("new", newest <= n).select("qid", "id", F.when(F.col("new"), F.round(F.least(score + 0.15, F.lit(1.0)), 6)).otherwise(score).alias("score"))


def search_pipeline(spark, sf):
    """Rank, gate, neighbours of the hits, time weight, duplicates, top ten: one plan."""
    t = M.turns(spark, sf)
    hits = top(bm25(M.tokens(spark, sf, "turns"), spark.createDataFrame([(0, QUERY)], "qid long, query string")), 20, F.desc("relevance"), "id").select("id", "relevance")
    wanted = F.array(*(F.lit(w) for w in sorted(set(QUERY.split()) - set(V.STOP_WORDS))))
    seeds = t.join(F.broadcast(hits), "id")  # twenty rows
    near = band(seeds, t, 3).select("id").distinct().join(hits, "id", "left_anti").join(t, "id")
    shared = F.size(F.array_intersect(F.array_distinct(T.tokens(F.col("content"))), wanted))
    near = near.withColumn("relevance", shared * 0.01).where("relevance > 0")
    both = seeds.unionByName(near.select(seeds.columns))
    scored = both.withColumn("score", F.round(F.col("relevance") * F.when(F.abs(F.col("moment") - CENTRE) <= HALF, V.INSIDE).otherwise(V.OUTSIDE), 4))
    once = F.row_number().over(W.partitionBy(T.normal(F.col("content"))).orderBy(F.desc("moment"), F.desc("id")))
    return top(scored.withColumn("n", once).where("n = 1"), 10, F.desc("score"), "id").select("rank", "id", "score")


QUERIES = {f.__name__: f for f in (neighbour_band_join, causal_band_join, session_adjacent, link_expand, history_expand, version_edges_sessions, contradiction_pairs_sessions, contradiction_partners_sessions, govern_window_sessions, temporal_weight, recency_boost, search_pipeline)}


def band_sql(seeds: str, radius: int) -> str:
    return f"with {M.TURNS} select s.id as seed_id, t.id, (t.position - s.position)::int as \"offset\" from turns s join turns t on s.session_id = t.session_id and t.position between s.position - {radius} and s.position + {radius} and t.id <> s.id where {seeds}"


def profile_sql(rows: str) -> str:
    c = "content"
    return f"""pr as (select *, list_distinct({tok(c)}) as tk, {X.stems(c)} as st, {X.content_words(c)} as wd, list_distinct(string_split({c}, '')) as le, {X.domain(c)} as dm, {X.pronoun(c)} as pn, {X.changed(c)} as ch, {X.revoked(c)} as rv, {X.negated(c)} as ng, {X.latin(c)} as lt, {X.triple_key(c)} as tr, {X.normal(c)} as ky, length({c}) as nc from {rows})"""


def pair_sql(user: str) -> str:
    """CTE pp: pairs o (older), n (newer) with overlap figures and rules."""
    both = ", ".join(f"o.{x} as o_{x}, n.{x} as n_{x}" for x in ("id", "source", "content", "tk", "st", "wd", "le", "dm", "pn", "ch", "rv", "ng", "lt", "tr", "ky", "nc"))
    return f"""p0 as (select {both}, len(list_intersect(o.tk, n.tk)) as sh from pr o join pr n on o.{user} = n.{user} and (o.moment, o.position, o.id) < (n.moment, n.position, n.id)),
pp as (select *, case when len(o_tk) > 0 and len(n_tk) > 0 then sh / (len(o_tk) + len(n_tk) - sh) else 0 end as j, case when len(o_tk) > 0 and len(n_tk) > 0 then sh / len(o_tk) else 0 end as cv,
  coalesce(o_dm = n_dm and (o_ch or n_ch or (n_dm = 'identity' and contains(o_content, '岁') and contains(n_content, '岁'))) and (sh > 0 or len(list_intersect(o_wd, n_wd)) > 0 or coalesce(o_pn = n_pn, false)), false) as sd,
  coalesce(o_tr = n_tr, false) as tv, coalesce(o_tr <> n_tr, false) as td from p0),
pq as (select *, n_nc >= 1.15 * o_nc and case when sh = len(o_tk) then len(o_tk) >= 3 or (len(o_tk) >= 2 and n_ch) else j >= 0.6 end as rw, tv or (sd and o_nc <= 160 and n_nc <= 160) as dv from pp)"""


def near_sql(rows: str, user: str) -> str:
    """CTEs to pq over rows: pairs of which the newer one is among the 300 of its user that follow the older one."""
    placed = f"placed as (select *, row_number() over (partition by {user} order by moment, position, id) as place from {rows})"
    return f"{placed}, {profile_sql('placed')}, {pair_sql(user).replace(' < (n.moment, n.position, n.id)', ' < (n.moment, n.position, n.id) and n.place - o.place <= 300')}"


P = phrases_sql()
STATED = f"{M.TURNS}, {P}, stated as (select id, session_id, position, source, content, moment from turns union all select -id, -session_id, position, source, content, session_id * 100 + position from phrases)"
VERSIONS = "select o_id as old_id, n_id as new_id, round(j, 4) as similarity from pq where (o_source = n_source or tv) and o_ky <> n_ky and not td and (dv or rw) and (dv or j >= 0.6 or cv >= 0.75)"
CONTRA = f"ct as (select o_id as a, n_id as b, case when o_ng <> n_ng then 'negation_flip' else {X.opposite('o_content', 'n_content')} end as signal from pq where o_source = n_source and o_dm = n_dm and not o_rv and not n_rv and len(list_intersect(o_le, n_le)) >= 2 and (not (o_lt or n_lt) or len(list_intersect(o_st, n_st)) >= 2 or {X.opposite('o_content', 'n_content')} is not null) and o_nc <= 160 and n_nc <= 160 and o_tr is null and n_tr is null)"
LINKS = "lk as (select a.id as from_id, b.id as to_id, case when a.session_id % 3 = 0 then 'explains' else 'related' end as relation from turns a join turns b on b.session_id = a.session_id + 1 and a.position = 0 and b.position = 0)"
WEIGHT = f"case when abs(moment - {CENTRE}) <= {HALF} then 1.25 else 0.8 end"
FIXED = f"q as (select 0 as qid, '{QUERY}' as query)"
ORACLE = {
    "neighbour_band_join": band_sql("true", 3),
    "causal_band_join": band_sql("s.source = 'system'", 5),
    "session_adjacent": band_sql("s.position = 2", 1),
    "link_expand": f"with {M.TURNS}, {LINKS}, u as (select id from turns where source = 'user'), x as (select from_id, to_id, relation from lk union select to_id, from_id, relation from lk) select * from x where from_id in (select id from u) and to_id in (select id from u)",
    "version_edges_sessions": f"with {STATED}, {near_sql('stated', 'session_id')} {VERSIONS}",
    "contradiction_pairs_sessions": f"with {STATED}, {near_sql('stated', 'session_id')}, {CONTRA} select * from ct where signal is not null",
    "contradiction_partners_sessions": f"with {STATED}, {near_sql('stated', 'session_id')}, {CONTRA}, b as (select a, b from ct where signal is not null union select b, a from ct where signal is not null) select distinct b as id, 0.5::double as score from b where a % 2 = 0 and b % 2 <> 0",
    "govern_window_sessions": f"""with {STATED}, kept as (select * from stated qualify row_number() over (partition by session_id, {X.normal('content')} order by moment desc, position desc, id desc) = 1), {near_sql('kept', 'session_id')},
w as (select o_id as id, max(j) as j, max(cv) as c from pq where o_source = n_source and (sd or rw) group by 1)
select k.session_id as qid, k.id, round(round(1.0::double / (k.position + 1), 4) * case when j > 0 or c > 0 then case when j >= 0.6 or c >= 0.75 then 0.25 else 0.5 end else 1 end, 4) as score from kept k left join w on k.id = w.id""",
    "temporal_weight": f"with {M.TURNS} select id, ({WEIGHT})::double as weight from turns",
    "recency_boost": f"""with {M.TURNS}, q as (select item_id as qid, text as query from benchmark), {bm25_sql('turns', 'q')},
h as (select qid, scores.id, relevance, moment from scores join turns on turns.id = scores.id qualify row_number() over (partition by qid order by relevance desc, scores.id) <= 20),
r as (select *, row_number() over (partition by qid order by moment desc, id) as n, greatest(1, floor(count(*) over (partition by qid) * 0.3)) as m from h)
select qid, id, case when n <= m then round(least(round(relevance / 100, 6) + 0.15, 1.0), 6) else round(relevance / 100, 6) end as score from r""",
    "search_pipeline": f"""with {M.TURNS}, {FIXED}, {bm25_sql('turns', 'q')}, h as (select id, relevance from scores order by relevance desc, id limit 20),
s as (select t.*, relevance from turns t join h on t.id = h.id), qt as (select list_distinct({tok('query')}) as k from q),
n as (select distinct t.* from s join turns t on t.session_id = s.session_id and t.position between s.position - 3 and s.position + 3 where t.id not in (select id from h)),
b as (select id, content, moment, relevance from s union all select id, content, moment, len(list_intersect(list_distinct({tok('content')}), k)) * 0.01::double from n, qt where len(list_intersect(list_distinct({tok('content')}), k)) > 0),
c as (select id, round(relevance * {WEIGHT}, 4) as score, row_number() over (partition by {X.normal('content')} order by moment desc, id desc) as u from b)
select row_number() over (order by score desc, id)::int as rank, id, score from c where u = 1 qualify rank <= 10""",
}

"""Queries of retrieval quality, budgets, percentiles, and batch ingestion."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.operators.evaluate import budgeted, ceilings, metrics, nearest, without_overlap
from annalist.operators.lexical import tokenized
from annalist.operators.selection import candidates
from annalist.plans.retrieval import bm25_sql, tok
from annalist.sources import model as M
from annalist.sources.store import stored


def asked(spark, sf):
    """The first turn of every session asks; gold are the session's other turns."""
    t = M.turns(spark, sf)
    return t.where("position = 0").select(F.col("id").alias("qid"), F.col("session_id").alias("qsession"), F.col("source").alias("qsource"), F.col("content").alias("query"))


def selected(spark, sf):
    """Up to five hits of each query within 4096 bytes, best first, from its whole ranking."""
    hits = candidates(M.tokens(spark, sf, "turns"), asked(spark, sf).select("qid", "query"), None, 5, 4096)
    return budgeted(hits.select("qid", "id", F.struct(-F.col("relevance"), "id").alias("rank"), "bytes"), 5, 4096)


def recent(spark, sf):
    """The recency baseline: the five newest turns, for every query."""
    t = M.turns(spark, sf).orderBy(F.desc("moment"), F.desc("id")).limit(5)
    ids = t.withColumn("rank", F.row_number().over(W.orderBy(F.desc("moment"), F.desc("id")))).select("id", "rank")
    return asked(spark, sf).select("qid").join(F.broadcast(ids))  # five rows


def gold(spark, sf):
    t = M.turns(spark, sf)
    return asked(spark, sf).join(t.select(F.col("session_id").alias("qsession"), "id"), "qsession").where("qid <> id").select("qid", "id")


def budget_select(spark, sf):
    return selected(spark, sf).select("qid", "rank", "id")


def scored(spark, sf):
    return metrics(asked(spark, sf).select("qid", "qsource"), selected(spark, sf), gold(spark, sf))


def retrieval_metrics(spark, sf):
    return scored(spark, sf).select("qid", "recall", "hit", "mrr")


def metrics_grouping_sets(spark, sf):
    rows = scored(spark, sf).withColumn("n_gold", F.least("n_gold", F.lit(5)))
    return rows.groupingSets([["qsource"], ["n_gold"], []], "qsource", "n_gold").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("hit"), 6).alias("hit"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg((F.col("recall") == 1).cast("int")), 6).alias("complete"))


def paired_outcomes(spark, sf):
    a = scored(spark, sf).select("qid", "recall")
    b = metrics(asked(spark, sf).select("qid"), recent(spark, sf), gold(spark, sf)).select("qid", F.col("recall").alias("other"))
    d = F.col("recall") - F.col("other")
    return a.join(b, "qid").agg(F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"))


def gold_diagnostics(spark, sf):
    """Of each question: whether its evidence is beyond the budget, what a perfect selector could reach, and how much of it shares
    no word with the question."""
    t, q, g = M.turns(spark, sf), asked(spark, sf), gold(spark, sf)
    sizes = g.join(t.select("id", F.octet_length("content").cast("long").alias("bytes")), "id")
    apart = without_overlap(g, tokenized(q, "query"), tokenized(t)).groupBy("qid").agg(F.count("*").alias("n"))
    out = ceilings(sizes, 5, 4096).join(apart, "qid", "left")
    return out.select("qid", "n_gold", "too_many", "too_large", F.round("ceiling", 6).alias("ceiling"), F.coalesce("n", F.lit(0)).cast("long").alias("without_overlap"))


def misses(spark, sf):
    """Evidence that the selection missed: how far the nearest selected turn of its session is, whether it shares a word."""
    t, q, g = M.turns(spark, sf), asked(spark, sf), gold(spark, sf)
    places = t.select("id", "session_id", "position")
    chosen = stored(selected(spark, sf).select("qid", "id"), "chosen")
    missed = g.join(chosen, ["qid", "id"], "left_anti").join(places, "id").select("qid", "id", "session_id", "position")
    far = nearest(missed, chosen.join(places, "id"))
    apart = without_overlap(missed, tokenized(q, "query"), tokenized(t)).select("qid", "id", F.lit(False).alias("overlap"))
    return far.join(apart, ["qid", "id"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(True)))


def miss_distances(spark, sf):
    return misses(spark, sf).select("qid", "id", "distance", "overlap")


def miss_report(spark, sf):
    """Misses within one and three turns of what was selected, in a session without any, and without a shared word, by speaker."""
    rows = misses(spark, sf).join(asked(spark, sf).select("qid", "qsource"), "qid")
    return rows.groupBy("qsource").agg(F.count("*").alias("missed"), F.count_if(F.col("distance") <= 1).alias("within_one"), F.count_if(F.col("distance") <= 3).alias("within_three"), F.count_if(F.col("distance").isNull()).alias("other_session"), F.count_if(~F.col("overlap")).alias("without_overlap"))


def latency_percentiles(spark, sf):
    e = M.table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))


def requests(spark, sf):
    return M.table(spark, sf, "events").select((F.col("event_id") % 700).alias("request_id"), F.col("event_id").alias("seq"), "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("moment"))


def idempotent_ingest(spark, sf):
    first = F.row_number().over(W.partitionBy("request_id").orderBy("seq"))
    return requests(spark, sf).withColumn("k", first).where("k = 1").select("request_id", "seq", "user_id")


def session_positions(spark, sf):
    """Positions of first requests in their user's session, after those of earlier requests."""
    order = W.partitionBy("user_id").orderBy("seq")
    return idempotent_ingest(spark, sf).select("seq", "user_id", (F.row_number().over(order) - 1).alias("position"))


def rejected_requests(spark, sf):
    """Validation: requests that an Add would refuse, by reason."""
    bad = F.when(F.col("value").isNull() | F.isnan("value"), "no_value").when(F.get_json_object("props", "$.k").isNull(), "no_label").when(F.col("value") < 1, "too_small")
    return M.table(spark, sf, "events").select(bad.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (budget_select, retrieval_metrics, metrics_grouping_sets, paired_outcomes, gold_diagnostics, miss_distances, miss_report, latency_percentiles, idempotent_ingest, session_positions, rejected_requests)}

ASKED = "asked as (select id as qid, session_id as qsession, source as qsource, content as query from turns where position = 0)"
CHAIN = f"""{M.TURNS}, {ASKED}, {bm25_sql('turns', 'asked')},
h as (select qid, scores.id, row_number() over (partition by qid order by relevance desc, scores.id) as rank, strlen(content)::bigint as bytes from scores join turns on turns.id = scores.id where qid <> scores.id),
  e as (select qid, max(rank) as last from h group by 1),
f as (select qid, 0::bigint as k, 0::bigint as used, []::bigint[] as got from asked
  union all select f.qid, k + 1, used + case when h.id is not null and used + bytes <= 4096 and len(got) < 5 then bytes else 0 end, case when h.id is not null and used + bytes <= 4096 and len(got) < 5 then list_append(got, h.id) else got end from f join e on e.qid = f.qid join h on h.qid = f.qid and h.rank = k + 1 where k < e.last and len(got) < 5),
g as (select qid, arg_max(got, k) as got from f group by 1),
sel as (select qid, unnest(got) as id, unnest(range(1, len(got) + 1)) as rank from g),
gold as (select qid, t.id from asked join turns t on t.session_id = qsession and t.id <> qid),
m as (select a.qid, qsource, count(gold.id) as n_gold, count(sel.id)::double / count(gold.id) as recall, (count(sel.id) > 0)::int as hit, coalesce(1.0 / min(sel.rank), 0)::double as mrr from asked a join gold on gold.qid = a.qid left join sel on sel.qid = gold.qid and sel.id = gold.id group by all)"""
MISSES = f"""{CHAIN}, tk as (select id, session_id, position, {tok('content')} as t, strlen(content)::bigint as bytes from turns),
ms as (select g.qid, g.id, qsource, (select min(abs(x.position - m.position)) from sel s join tk x on x.id = s.id where s.qid = g.qid and x.session_id = m.session_id) as distance, len(list_intersect(q.t, m.t)) > 0 as overlap
  from gold g join tk m on m.id = g.id join tk q on q.id = g.qid join asked on asked.qid = g.qid where not exists (select 1 from sel where sel.qid = g.qid and sel.id = g.id))"""
ORACLE = {
    "gold_diagnostics": f"""with recursive {CHAIN}, tk as (select id, {tok('content')} as t, strlen(content)::bigint as bytes from turns),
r as (select g.qid, g.id, m.bytes, row_number() over (partition by g.qid order by m.bytes, g.id) as n, sum(m.bytes) over (partition by g.qid order by m.bytes, g.id) as used, len(list_intersect(q.t, m.t)) = 0 as apart from gold g join tk m on m.id = g.id join tk q on q.id = g.qid)
select qid, count(*) as n_gold, count(*) > 5 as too_many, sum(bytes) > 4096 as too_large, round(count(*) filter (where n <= 5 and used <= 4096)::double / count(*), 6) as ceiling, count(*) filter (where apart) as without_overlap from r group by qid""",
    "miss_distances": f"with recursive {MISSES} select qid, id, distance, overlap from ms",
    "miss_report": f"with recursive {MISSES} select qsource, count(*) as missed, count(*) filter (where distance <= 1) as within_one, count(*) filter (where distance <= 3) as within_three, count(*) filter (where distance is null) as other_session, count(*) filter (where not overlap) as without_overlap from ms group by 1",
    "budget_select": f"with recursive {CHAIN} select qid, rank::int as rank, id from sel",
    "retrieval_metrics": f"with recursive {CHAIN} select qid, recall, hit, mrr from m",
    "metrics_grouping_sets": f"with recursive {CHAIN}, n as (select * replace (least(n_gold, 5) as n_gold) from m) select qsource, n_gold, count(*) as n, round(avg(recall), 6) as recall, round(avg(hit), 6) as hit, round(avg(mrr), 6) as mrr, round(avg((recall = 1)::int), 6) as complete from n group by grouping sets ((qsource), (n_gold), ())",
    "paired_outcomes": f"with recursive {CHAIN}, r as (select id from turns order by moment desc, id desc limit 5), b as (select gold.qid, count(r.id)::double / count(gold.id) as other from gold left join r on r.id = gold.id group by 1) select count(*) filter (where recall > other) as wins, count(*) filter (where recall = other) as ties, count(*) filter (where recall < other) as losses from m join b using (qid)",
    "latency_percentiles": "select event_type, round(quantile_cont(value, 0.5), 6) as p50, quantile_disc(value, 0.95) as p95 from events group by 1",
    "idempotent_ingest": "select event_id % 700 as request_id, min(event_id) as seq, arg_min(user_id, event_id) as user_id from events group by 1",
    "session_positions": "with f as (select min(event_id) as seq, arg_min(user_id, event_id) as user_id from events group by event_id % 700) select seq, user_id, (row_number() over (partition by user_id order by seq) - 1)::int as position from f",
    "rejected_requests": "with r as (select case when value is null or isnan(value) then 'no_value' when json_extract_string(props, '$.k') is null then 'no_label' when value < 1 then 'too_small' end as reason from events) select reason, count(*) as n from r where reason is not null group by 1",
}

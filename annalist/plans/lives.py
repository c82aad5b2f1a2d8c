"""Queries of lifecycle commands with guards: audit, states, anchors, canon, forgotten, frames, conflicts, links, contexts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions import vocab as V
from annalist.operators import lifecycle as L
from annalist.operators.lexical import numbered, top
from annalist.sources import model as M

DAY = 86400
NOW = M.EPOCH + 58 * DAY


def acts(spark, sf):
    """Events as lifecycle commands of all kinds; the first event of a user is the capture of a memory."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = M.table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("memory_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("moment"), "event_type", k.alias("k"))
    first = F.min("seq").over(W.partitionBy("memory_id"))
    kind, odd = F.col("event_type"), F.col("seq") % 2 == 1
    view = F.element_at(F.array(*map(F.lit, ["review", "unpin", "decanonize"])), (F.col("seq") % 3 + 1).cast("int"))
    error = F.element_at(F.array(*map(F.lit, ["forget", "flag", "set_frame", "end_scope"])), (F.col("seq") % 4 + 1).cast("int"))
    op = F.when(F.col("seq") == first, "remember").when(kind == "click", "corroborate").when(kind == "view", view).when(kind == "purchase", F.when(odd, "canonize").otherwise("promote")).when(kind == "signup", F.when(odd, "restore").otherwise("pin")).otherwise(error)
    m = F.col("memory_id")
    voice = F.when(F.col("k") % 6 == 5, F.lit("  ")).otherwise(F.concat(F.lit("s"), F.col("k") % 6))
    rows = e.withColumn("op", op).withColumn("scope", F.when(F.col("op").isin("canonize", "end_scope") | ((F.col("op") == "decanonize") & (F.col("k") % 5 != 0)), F.concat(F.lit("c"), F.col("k") % 4)))
    tier = F.when(m % 50 == 49, "testimony").when(m % 5 == 0, "interpretation").otherwise("archive")
    return rows.select("seq", "memory_id", "moment", "op", voice.alias("label"), "scope", F.when(m % 4 != 0, voice).alias("source"), tier.alias("tier"), (m % 3 == 0).alias("sensitive"))


def audit(spark, sf):
    return L.replay(acts(spark, sf))


def states(spark, sf):
    return L.last_states(acts(spark, sf))


def lifecycle_audit(spark, sf):
    """The whole audit: what every command did or why it was refused."""
    return audit(spark, sf).select("seq", "memory_id", "op", "action")


def audit_newest(spark, sf):
    """The newest fifty accepted or denied commands."""
    return top(audit(spark, sf), 50, F.desc("moment"), F.desc("seq"), "memory_id").select("rank", "seq", "memory_id", "action")


def lifecycle_states(spark, sf):
    return states(spark, sf).select("memory_id", "tier", "status", "consolidated_at", "reason", "pinned_at", "forgotten_at", "sensitive", "independent", F.size("canon").alias("scopes"), "reviewed_at", "frame")


def corroborated_tiers(spark, sf):
    """What provenance says of each memory, with the warning for testimony that isn't corroborated."""
    s = states(spark, sf)
    return s.select("memory_id", "tier", "origin_known", "independent", (F.col("independent") > 0).alias("satisfied"), ((F.col("tier") == "testimony") & (F.col("independent") == 0)).alias("warning"))


def anchors_listed(spark, sf):
    """Anchors of living memories in the order in which they were pinned; whether they are more than the soft limit."""
    rows = states(spark, sf).where("pinned_at is not null and forgotten_at is null").select("memory_id", "pinned_at", "reason")
    n = rows.agg(F.count("*").alias("n"))
    return numbered(rows, "pinned_at", "memory_id").join(F.broadcast(n)).select("rank", "memory_id", "pinned_at", "reason", (F.col("n") > V.ANCHOR_LIMIT).alias("too_many"))  # one row


def forgotten_newest(spark, sf):
    return top(states(spark, sf).where("forgotten_at is not null"), 50, F.desc("forgotten_at"), "memory_id").select("rank", "memory_id", "forgotten_at")


def canon_listed(spark, sf):
    """Active canon entries of living memories, and whether recall may use them; the oldest entry of a memory stands for it."""
    rows = states(spark, sf).where("forgotten_at is null").select("memory_id", "sensitive", "independent", F.explode("canon").alias("c"))
    rows = rows.select("memory_id", "c.scope", F.col("c.at").alias("canonized_at"), (~F.col("sensitive") | (F.col("independent") > 0)).alias("eligible"))
    first = F.row_number().over(W.partitionBy("memory_id").orderBy("canonized_at", "scope")) == 1
    return rows.withColumns({"stands": first, "scopes": F.count("*").over(W.partitionBy("memory_id"))})


def scopes_active(spark, sf):
    """Scopes with active canon entries; the soft limit is on the entries of all scopes."""
    rows = states(spark, sf).select(F.explode("canon.scope").alias("scope")).groupBy("scope").agg(F.count("*").alias("entries"))
    total = rows.agg(F.sum("entries").alias("total"))
    return rows.join(F.broadcast(total)).select("scope", "entries", (F.col("total") > V.CANON_LIMIT).alias("too_many"))  # one row


def frames_listed(spark, sf):
    return states(spark, sf).where("frame is not null").groupBy("frame").agg(F.count("*").alias("n"))


def reviews_due(spark, sf):
    """Interpretations of living memories that nobody has reviewed within thirty days."""
    cut = NOW - V.REVIEW_DAYS * DAY
    return states(spark, sf).where(f"tier = 'interpretation' and forgotten_at is null and (reviewed_at is null or reviewed_at < {cut})").select("memory_id", "reviewed_at")


def consolidated_first(spark, sf):
    """Living memories that aren't anchors: consolidated ones first, newest capture first, then by id."""
    rows = states(spark, sf).where("forgotten_at is null and pinned_at is null")
    return top(rows, 60, F.desc(F.col("status") == "consolidated"), F.desc("created_at"), "memory_id").select("rank", "memory_id", "status")


def conflict_commands(spark, sf):
    """Every ninth event marks a conflict of two memories, others resolve it; an outsider can't be adopted."""
    e = M.table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("x"), ((F.col("user_id") * 7 + F.col("event_id") % 3) % 150).alias("y")).where("x <> y")
    rows = e.select("seq", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(F.col("seq") % 9 == 0, "mark").when(F.col("seq") % 9 == 4, "resolve").alias("op"), F.when(F.col("seq") % 2 == 0, F.col("x")).when(F.col("seq") % 5 == 0, F.lit(-1)).alias("adopted"))
    return rows.where("op is not null and not (op = 'resolve' and coalesce(adopted = -1, false))")


def conflict_records(spark, sf):
    return L.alternating(conflict_commands(spark, sf), ["a", "b"], "mark", "resolve").select("a", "b", "opened", "closed", F.col("closing.adopted").alias("adopted"))


def conflicts_shown(spark, sf):
    """Open conflicts of two living memories, with both sides' states."""
    s = states(spark, sf).where("forgotten_at is null").select("memory_id", "status", "frame")
    side = lambda x: s.toDF(x, f"status_{x}", f"frame_{x}")
    return conflict_records(spark, sf).where("closed is null").join(side("a"), "a").join(side("b"), "b").select("a", "b", "opened", "status_a", "frame_a", "status_b", "frame_b")


def link_commands(spark, sf):
    e = M.table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("from_id"), ((F.col("user_id") * 11 + F.col("event_id") % 2) % 150).alias("to_id"), (F.col("event_id") % 12).alias("r"))
    relation = F.element_at(F.array(*map(F.lit, ["related", "updates", "explains"])), (F.col("from_id") % 3 + 1).cast("int"))
    return e.where("from_id <> to_id").select("seq", "from_id", "to_id", relation.alias("relation"), F.when(F.col("r") < 3, "link").when(F.col("r") == 7, "unlink").alias("op")).where("op is not null")


def link_records(spark, sf):
    """Links between memories: made once while active, retired once; in the order in which they were made."""
    return L.alternating(link_commands(spark, sf), ["from_id", "to_id", "relation"], "link", "unlink").select("from_id", "to_id", "relation", "opened", "closed")


def links_of_memory(spark, sf):
    """Active links from or to one memory, oldest first."""
    r = link_records(spark, sf).where("closed is null")
    rows = r.where("from_id = 7").unionByName(r.where("to_id = 7 and from_id <> 7"))
    return numbered(rows, "opened", "from_id", "to_id").select("rank", "from_id", "to_id", "relation", "opened")


def contexts(spark, sf):
    """History contexts: purchases say when and where in a session a memory was said; some say nothing."""
    e = M.table(spark, sf, "events").where("event_type = 'purchase'")
    known = F.col("event_id") % 4 != 0
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("memory_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("event_at"), F.when(known, F.col("event_id") % 23).alias("session_id"), F.when(known, F.col("event_id") % 29).alias("position"))


def context_changes(spark, sf):
    """Each replaced context with what it replaced; a place that another memory has had is refused."""
    out = L.moved(contexts(spark, sf))
    year = lambda c: F.get_json_object(c, "$.event_at").cast("long")
    return out.select("seq", "memory_id", "refused", "changed", year("before").alias("before_at"), year("after").alias("after_at"))


QUERIES = {f.__name__: f for f in (lifecycle_audit, audit_newest, lifecycle_states, corroborated_tiers, anchors_listed, forgotten_newest, canon_listed, scopes_active, frames_listed, reviews_due, consolidated_first, conflict_records, conflicts_shown, link_records, links_of_memory, context_changes)}

ACTS = f"""acts as (
  select seq, memory_id, moment, k, op, case when op in ('canonize', 'end_scope') or (op = 'decanonize' and k % 5 <> 0) then 'c' || (k % 4) end as scope, case when k % 6 = 5 then '  ' else 's' || (k % 6) end as label
  from (select event_id as seq, user_id as memory_id, floor(epoch(ts))::bigint as moment, json_extract_string(props, '$.k')::int as k,
    case when event_id = min(event_id) over (partition by user_id) then 'remember' when event_type = 'click' then 'corroborate' when event_type = 'view' then ['review', 'unpin', 'decanonize'][event_id % 3 + 1]
      when event_type = 'purchase' then case when event_id % 2 = 1 then 'canonize' else 'promote' end when event_type = 'signup' then case when event_id % 2 = 1 then 'restore' else 'pin' end
      else ['forget', 'flag', 'set_frame', 'end_scope'][event_id % 4 + 1] end as op from events)),
cmds as (select seq, memory_id, moment, op, scope, label from acts where op <> 'end_scope'
  union all select e.seq, h.memory_id, e.moment, e.op, e.scope, e.label from acts e join (select distinct memory_id, scope from acts where op = 'canonize') h on h.scope = e.scope where e.op = 'end_scope'),
num as (select *, row_number() over (partition by memory_id order by seq) as k from cmds),
-- one command after the other, for all memories at once
st as (
  select memory_id, 0::bigint as k, null::bigint as seq, null::bigint as moment, null::varchar as op, null::varchar as action, false as known, 'archive' as tier, 'working' as status, null::bigint as cons, null::varchar as reason, null::bigint as pinned, null::bigint as forgotten,
    memory_id % 3 = 0 as sens, null::varchar as src, []::varchar[] as voices, []::varchar[] as canon, []::bigint[] as since, null::bigint as reviewed, null::varchar as frame from (select distinct memory_id from cmds)
  union all
  select memory_id, k, seq, moment, op, action, known or coalesce(action = 'remember', false),
    case when action = 'remember' and memory_id % 5 = 0 then 'interpretation' when action like '%upgrade' then 'testimony' else tier end,
    case when action = 'promote' then 'consolidated' else status end, case when action = 'promote' then coalesce(cons, moment) else cons end, case when action = 'promote' then label else reason end,
    case when action = 'pin' then moment when action = 'unpin' or action like '%unpin_by%' then null else pinned end, case when action = 'forget' then coalesce(forgotten, moment) when action = 'restore' then null else forgotten end,
    sens or (known and op = 'flag'), case when action = 'remember' and memory_id % 4 <> 0 then label else src end, case when action like 'corroborate%' then heard else voices end,
    case when action = 'canonize' then list_append(canon, scope) when action = 'end_scope' or (action = 'decanonize' and scope is not null) then list_filter(canon, lambda x: x <> scope) when action = 'decanonize' or action like '%decanonize_by%' then [] else canon end,
    case when action = 'canonize' then list_append(since, moment) when action = 'end_scope' or (action = 'decanonize' and scope is not null) then list_filter(since, lambda x, i: canon[i] <> scope) when action = 'decanonize' or action like '%decanonize_by%' then [] else since end,
    case when action = 'review' or (action = 'remember' and memory_id % 5 = 0) then moment else reviewed end, case when action = 'set_frame' then label else frame end
  from (select *, case when not known and op <> 'remember' then case when op = 'end_scope' then null else 'unknown_memory' end
      when op = 'remember' then case when known then 'exists' when memory_id % 50 = 49 then 'testimony_refused' else 'remember' end when op = 'promote' then 'promote' when op = 'set_frame' then 'set_frame'
      when op in ('pin', 'canonize') then case when forgotten is not null then 'is_forgotten' when status <> 'consolidated' then 'not_consolidated' when sens and ind < 1 then op || '_denied' when op = 'canonize' and list_contains(canon, scope) then 'in_canon' else op end
      when op = 'unpin' then case when pinned is null then 'unpin_noop' else 'unpin' end when op = 'forget' then case when pinned is not null then 'is_anchored' when len(canon) > 0 then 'is_canon' else 'forget' end
      when op = 'restore' then case when forgotten is null then 'not_forgotten' else 'restore' end when op = 'review' then case when tier = 'interpretation' then 'review' else 'not_interpretation' end
      when op = 'corroborate' then case when trim(label) = '' then 'blank_source' when tier = 'archive' and ind2 > 0 then 'corroborate+corroborate_upgrade' else 'corroborate' end
      when op = 'flag' then 'flag_sensitive' || case when ind < 1 and pinned is not null then '+unpin_by_sensitivity' else '' end || case when ind < 1 and len(canon) > 0 then '+decanonize_by_sensitivity' else '' end
      when op = 'decanonize' then case when (scope is null and len(canon) > 0) or list_contains(canon, scope) then 'decanonize' else 'not_canon' end when list_contains(canon, scope) then 'end_scope' end as action
    from (select *, case when coalesce(trim(src), '') = '' then greatest(len(voices) - 1, 0) else len(voices) - list_contains(voices, trim(src))::int end as ind, case when coalesce(trim(src), '') = '' then greatest(len(heard) - 1, 0) else len(heard) - list_contains(heard, trim(src))::int end as ind2
      from (select st.memory_id, num.k, num.seq, num.moment, num.op, num.scope, num.label, known, tier, status, cons, reason, pinned, forgotten, sens, src, voices, canon, since, reviewed, frame,
          case when num.op = 'corroborate' and trim(num.label) <> '' then list_distinct(list_append(voices, trim(num.label))) else voices end as heard from st join num on num.memory_id = st.memory_id and num.k = st.k + 1)))),
fin as (select *, case when coalesce(trim(src), '') = '' then greatest(len(voices) - 1, 0) else len(voices) - list_contains(voices, trim(src))::int end::int as independent from st where known qualify row_number() over (partition by memory_id order by k desc) = 1)"""
CONFLICTS = """cc as (select * from (select event_id as seq, least(user_id, y) as a, greatest(user_id, y) as b, case event_id % 9 when 0 then 'mark' when 4 then 'resolve' end as op, case when event_id % 2 = 0 then user_id when event_id % 5 = 0 then -1 end as adopted
  from (select *, (user_id * 7 + event_id % 3) % 150 as y from events) where user_id <> y) where op = 'mark' or (op = 'resolve' and adopted is distinct from -1)),
-- the n-th opening is the first mark after the n-1-th closing, and so on
cr as (select a, b, seq as opened, (select min(d.seq) from cc d where d.a = c.a and d.b = c.b and d.op = 'resolve' and d.seq > c.seq) as closed from cc c where op = 'mark' and coalesce((select d.op from cc d where d.a = c.a and d.b = c.b and d.seq < c.seq order by d.seq desc limit 1), 'resolve') = 'resolve'),
rec as (select cr.*, (select adopted from cc where cc.seq = cr.closed) as adopted from cr)"""
LINKS = """lc as (select * from (select event_id as seq, user_id as from_id, (user_id * 11 + event_id % 2) % 150 as to_id, ['related', 'updates', 'explains'][user_id % 3 + 1] as relation, case when event_id % 12 < 3 then 'link' when event_id % 12 = 7 then 'unlink' end as op from events) where from_id <> to_id and op is not null),
lr as (select from_id, to_id, relation, seq as opened, (select min(d.seq) from lc d where (d.from_id, d.to_id, d.relation, d.op) = (c.from_id, c.to_id, c.relation, 'unlink') and d.seq > c.seq) as closed from lc c
  where op = 'link' and coalesce((select arg_max(d.op, d.seq) from lc d where (d.from_id, d.to_id, d.relation) = (c.from_id, c.to_id, c.relation) and d.seq < c.seq), 'unlink') = 'unlink')"""
R = f"with recursive {ACTS}"
ORACLE = {
    "lifecycle_audit": f"{R} select seq, memory_id, op, action from st where action is not null",
    "audit_newest": f"{R} select row_number() over (order by moment desc, seq desc, memory_id)::int as rank, seq, memory_id, action from st where action is not null qualify rank <= 50",
    "lifecycle_states": f"{R} select memory_id, tier, status, cons as consolidated_at, reason, pinned as pinned_at, forgotten as forgotten_at, sens as sensitive, independent, len(canon)::int as scopes, reviewed as reviewed_at, frame from fin",
    "corroborated_tiers": f"{R} select memory_id, tier, coalesce(trim(src), '') <> '' as origin_known, independent, independent > 0 as satisfied, tier = 'testimony' and independent = 0 as warning from fin",
    "anchors_listed": f"{R} select row_number() over (order by pinned, memory_id)::int as rank, memory_id, pinned as pinned_at, reason, count(*) over () > 12 as too_many from fin where pinned is not null and forgotten is null",
    "forgotten_newest": f"{R} select row_number() over (order by forgotten desc, memory_id)::int as rank, memory_id, forgotten as forgotten_at from fin where forgotten is not null qualify rank <= 50",
    "canon_listed": f"{R}, u as (select memory_id, unnest(canon) as scope, unnest(since) as canonized_at, not sens or independent > 0 as eligible from fin where forgotten is null) select *, row_number() over (partition by memory_id order by canonized_at, scope) = 1 as stands, count(*) over (partition by memory_id) as scopes from u",
    "scopes_active": f"{R}, u as (select unnest(canon) as scope from fin) select scope, count(*) as entries, sum(count(*)) over () > 8 as too_many from u group by scope",
    "frames_listed": f"{R} select frame, count(*) as n from fin where frame is not null group by frame",
    "reviews_due": f"{R} select memory_id, reviewed as reviewed_at from fin where tier = 'interpretation' and forgotten is null and (reviewed is null or reviewed < {NOW - 30 * DAY})",
    "consolidated_first": f"{R} select row_number() over (order by (status = 'consolidated')::int desc, born desc, memory_id)::int as rank, memory_id, status from fin join (select memory_id as m, arg_min(moment, seq) as born from acts where op = 'remember' group by 1) on m = memory_id where forgotten is null and pinned is null qualify rank <= 60",
    "conflict_records": f"with {CONFLICTS} select * from rec",
    "conflicts_shown": f"{R}, {CONFLICTS} select rec.a, rec.b, opened, x.status as status_a, x.frame as frame_a, y.status as status_b, y.frame as frame_b from rec join fin x on x.memory_id = rec.a and x.forgotten is null join fin y on y.memory_id = rec.b and y.forgotten is null where closed is null",
    "link_records": f"with {LINKS} select * from lr",
    "links_of_memory": f"with {LINKS} select row_number() over (order by opened, from_id, to_id)::int as rank, from_id, to_id, relation, opened from lr where closed is null and (from_id = 7 or to_id = 7)",
    "context_changes": """with c as (select event_id as seq, user_id as memory_id, floor(epoch(ts))::bigint as event_at, case when event_id % 4 <> 0 then event_id % 23 end as s, case when event_id % 4 <> 0 then event_id % 29 end as p from events where event_type = 'purchase'),
d as (select *, coalesce((select arg_min(memory_id, seq) from c x where x.s = c.s and x.p = c.p and x.seq < c.seq) <> memory_id, false) as refused from c),
e as (select *, (select max(seq) from d x where x.memory_id = d.memory_id and x.seq < d.seq and not x.refused) as prev from d)
select e.seq, e.memory_id, e.refused, not e.refused and (b.seq is null or (b.event_at, b.s, b.p) is distinct from (e.event_at, e.s, e.p)) as changed, b.event_at as before_at, e.event_at as after_at from e left join d b on b.seq = e.prev""",
}

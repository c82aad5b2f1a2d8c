"""Queries of the claim ledger (commands, views as of a time, recall) and of narratives with their dependencies."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.operators import claims as C
from annalist.operators.lexical import numbered, ranked, top
from annalist.operators.ordered import running_max
from annalist.plans import lives
from annalist.plans.retrieval import QUERY, bm25_sql
from annalist.sources import model as M
from annalist.sources.store import stored

DAY = 86400
GONE = 883612800  # 1998-01-01: some sources are forgotten then
STALE = 852076800  # 1997-01-01: from then on the review of some sources, interpretations, is overdue
AS_OF = 896659200  # 1998-06-01
VALID_AT = 890000000


def at(column):
    return F.unix_timestamp(F.col(column).cast("timestamp"))


def sources(spark, sf):
    """Parts as sources of claims: forgotten at, sensitive, corroborated, overdue for review from, and what they say."""
    p = M.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("memory_id"), F.when(F.col("p_size") == 13, F.lit(GONE).cast("long")).alias("gone_at"), (F.col("p_size") % 7 == 0).alias("memory_sensitive"), (F.col("p_partkey") % 2 == 0).alias("corroborated"), F.when(F.col("p_size") % 11 == 3, F.lit(STALE).cast("long")).alias("stale_at"), F.coalesce("p_name", F.lit("")).alias("content"))


def proposed(spark, sf):
    o = M.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("scope"), (F.col("o_orderkey") % 9 == 0).alias("sensitive"), at("o_orderdate").alias("recorded_at"), "o_orderstatus")


def group(claim_id):
    """Revisions connect claims of one decade of ids."""
    return F.floor(F.col(claim_id) / 10)


def of_groups(rows, claim_id, groups):
    """Rows of claims of some groups (grp); of all where groups is None."""
    return rows if groups is None else rows.join(groups, group(claim_id) == groups["grp"], "left_semi")


def commands(spark, sf, groups=None):
    """Orders and line items as a ledger's commands: claims are made, get evidence, lose some, are adopted, withdrawn, revised."""
    claim, src = of_groups(proposed(spark, sf), "id", groups), sources(spark, sf)
    item = of_groups(M.table(spark, sf, "lineitem"), "l_orderkey", groups).join(claim.select(F.col("id").alias("l_orderkey"), "recorded_at"), "l_orderkey")
    eid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", at("l_shipdate"))
    stance = F.when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "R", "challenges").otherwise("context")
    added = item.select(F.col("l_orderkey").alias("claim_id"), F.greatest(at("l_shipdate"), "recorded_at").alias("at"), eid.alias("evidence_id"), F.col("l_partkey").alias("memory_id"), stance.alias("stance"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("origin_id"), "l_linestatus")
    quote = F.when(F.col("memory_id") % 19 == 0, F.concat("content", F.lit("?"))).otherwise(F.substring("content", 2, 9))
    added = added.join(src, "memory_id").withColumn("quoted", F.col("content").contains(quote)).drop("content")
    # a row gives the evidence and, where the line is open, its retraction: the joins are made once for both
    both = F.explode(F.when(F.col("l_linestatus") == "O", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("rank")
    cites = F.col("rank") == 1
    told = ["memory_id", "stance", "origin_id", "gone_at", "memory_sensitive", "corroborated", "stale_at", "quoted"]
    cited = added.select("*", both).select("claim_id", F.when(cites, F.col("at")).otherwise(F.col("at") + 30 * DAY).alias("at"), "rank", F.when(cites, "evidence").otherwise("retract").alias("op"), "evidence_id", *(F.when(cites, F.col(c)).alias(c) for c in told))
    changed = added.where("gone_at is not null").select("claim_id", F.lit(GONE).cast("long").alias("at"), F.lit(3).alias("rank"), F.lit("source_changed").alias("op"), "memory_id").distinct()
    made = claim.select(F.col("id").alias("claim_id"), F.col("recorded_at").alias("at"), F.lit(0).alias("rank"), F.lit("create").alias("op"), "scope", "sensitive")

    def later(days, rank, op, rule, *more):
        return claim.where(rule).select(F.col("id").alias("claim_id"), (F.col("recorded_at") + days * DAY).alias("at"), F.lit(rank).alias("rank"), F.lit(op).alias("op"), *more)

    parts = [made, cited, changed, later(100, 4, "adopt", "o_orderstatus <> 'P'"), later(160, 4, "adopt", "id % 4 = 0"), later(150, 5, "revise", "id % 10 = 0", (F.col("id") + 1).alias("other_id")), later(120, 6, "withdraw", "o_orderstatus = 'P'"), later(140, 6, "withdraw", "id % 11 = 0")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("grp", group("claim_id"))


def answers(spark, sf, *fields):
    return C.ledger(commands(spark, sf), *fields)


def ledger_answers(spark, sf):
    return answers(spark, sf, "at", "claim_id", "op", "answer").groupBy("op", "answer").agg(F.count("*").alias("n"), F.sum("claim_id").alias("ids"), F.sum("at").alias("times"))


def ledger_states(spark, sf):
    """State events of all claims."""
    return answers(spark, sf, "at", "claim_id", "action", "replacement_id").where(F.col("action").isin(*C.STATES)).select("claim_id", "at", "action", "replacement_id")


def viewed(spark, sf, as_of, groups=None):
    """Claims as of a time; of some groups (grp) alone, as no other group's commands bear on them."""
    return C.view(of_groups(proposed(spark, sf), "id", groups).drop("o_orderstatus"), commands(spark, sf, groups), as_of)


FIELDS = ["id", "status", "supporting", "challenging", "origins", "unknown_origins", "redacted", "review_required", "eligible"]


def ledger_view_as_of(spark, sf):
    return viewed(spark, sf, AS_OF).select(FIELDS)


def ledger_view_now(spark, sf):
    return viewed(spark, sf, None).select(FIELDS)


def claims_recalled(spark, sf):
    """Eligible claims of one scope, valid at a time, by relevance of their text; newest first where that is equal."""
    v = viewed(spark, sf, AS_OF).where("eligible and scope = '2-HIGH'")
    dated = v.withColumns({"valid_from": F.when(F.col("id") % 3 != 0, F.col("recorded_at")), "valid_until": F.when(F.col("id") % 2 == 0, F.col("recorded_at") + 900 * DAY)})
    dated = dated.where(f"(valid_from is null or valid_from <= {VALID_AT}) and (valid_until is null or {VALID_AT} < valid_until)")
    text = M.materials(spark, sf).select(F.col("id").alias("doc"), "content")
    many = text.agg(F.greatest(F.count("*"), F.lit(1)).alias("many"))  # one row
    rows = dated.join(F.broadcast(many)).join(text, F.col("id") % F.col("many") == F.col("doc")).select("id", "content", "recorded_at")
    n = rows.agg(F.count("*").alias("eligible_count"))
    return top(ranked(rows, QUERY), 10, F.desc("relevance"), F.desc("recorded_at"), "id").join(F.broadcast(n)).select("rank", "id", "relevance", "eligible_count", (F.col("eligible_count") > 10).alias("truncated"))


def ledger_clock(spark, sf):
    """Recording times that never go back: the greatest so far, in each scope."""
    return running_max(proposed(spark, sf), "scope", "id", "recorded_at", "ledger_time").select("id", "ledger_time")


def claims_of_source(spark, sf):
    """Open claims that a forgotten source's active evidence supports, challenges or explains, by source."""
    a = answers(spark, sf, "claim_id", "answer", "memory_id").where("answer = 'source_changed'")
    return a.groupBy("memory_id").agg(F.count("*").alias("claims"), F.min("claim_id").alias("first_claim"))


def accounts(spark, sf):
    """Narratives: forty events in a row make an account of their users, of three claims and a link; some lists are malformed."""
    c = M.commands(spark, sf).withColumn("id", F.floor(F.col("seq") / 40))
    made = c.groupBy("id").agg(F.max("moment").alias("created_at"), F.sort_array(F.collect_set("memory_id")).alias("members"))
    i = F.col("id")
    bad = F.when(i % 17 == 0, F.lit('["x"')).when(i % 7 == 3, F.lit("[]"))
    members = F.transform(F.slice("members", 1, 3), lambda x: x.cast("string"))
    members = F.when(i % 13 == 5, F.concat(members, F.array(F.lit("9999")))).otherwise(members)
    listed = lambda xs: F.to_json(F.transform(xs, lambda x: x.cast("string")))
    return made.select("id", "created_at", F.concat(F.lit("n"), i % 9).alias("scope"), (i % 4 == 1).alias("sensitive"), F.coalesce(bad, F.to_json(members)).alias("memory_ids"), F.when(i % 3 == 0, listed(F.array(i * 3, i * 3 + 1, F.when(i % 6 == 0, F.lit(10**9)).otherwise(i * 3 + 2)))).alias("claim_ids"), F.when(i % 5 == 0, listed(F.array(i))).alias("link_ids"))


IDS = "array<string>"


def account_issues(spark, sf):
    """Every live issue of a narrative's dependencies, counted: malformed lists, missing or forgotten or overdue or doubtful
    sources, claims that recall may not use, links that are retired."""
    n = accounts(spark, sf)
    parsed = lambda c: F.from_json(c, IDS, {"mode": "PERMISSIVE"})
    bad = lambda c: F.col(c).isNotNull() & (parsed(F.col(c)).isNull() | ~F.col(c).endswith("]"))
    ids = lambda c: F.when(bad(c), F.array().cast(IDS)).otherwise(F.coalesce(parsed(F.col(c)), F.array().cast(IDS)))
    n = n.withColumns({"malformed": bad("memory_ids"), "mids": ids("memory_ids"), "cids": ids("claim_ids"), "lids": ids("link_ids")})
    n = stored(n.select("id", "sensitive", "malformed", "mids", "cids", "lids"), "accounts")
    cited = n.select("id", F.explode(F.transform("cids", lambda x: x.cast("long"))).alias("claim_id"))
    groups = stored(cited.where("claim_id is not null").select(group("claim_id").alias("grp")).distinct(), "groups")
    found = n.where("malformed").select("id", F.lit("invalid_memory_ids").alias("issue"))
    view = viewed(spark, sf, None, groups).select(F.col("id").alias("claim_id"), "eligible", F.col("sensitive").alias("claim_sensitive"))
    claims = stored(cited.join(view, "claim_id", "left"), "cited")
    claim_issue = F.when(F.col("eligible").isNull(), "missing_claim").when(~F.col("eligible"), "unusable_claim")
    found = found.unionByName(claims.select("id", claim_issue.alias("issue")).where("issue is not null"))
    links = numbered(lives.link_records(spark, sf), "opened", "from_id", "to_id", "relation").withColumnRenamed("rank", "link")  # as they came
    linked = n.select("id", F.explode(F.transform("lids", lambda x: x.cast("int"))).alias("link")).join(links, "link", "left")
    found = found.unionByName(linked.where("opened is null or closed is not null").select("id", F.lit("unusable_relationship").alias("issue")))
    # sources: the narrative's own, and both ends of its links
    own = n.select("id", F.explode(F.transform("mids", lambda x: x.cast("long"))).alias("memory_id")).unionByName(linked.where("from_id is not null").select("id", F.explode(F.array("from_id", "to_id")).alias("memory_id"))).distinct()
    doubt = claims.groupBy("id").agg(F.bool_or(F.coalesce("claim_sensitive", F.lit(False))).alias("by_claim"))
    n = n.join(doubt, "id", "left").select("id", (F.col("sensitive") | F.coalesce("by_claim", F.lit(False))).alias("sensitive"))
    state = lives.states(spark, sf).select("memory_id", "tier", "forgotten_at", "reviewed_at", F.col("sensitive").alias("source_sensitive"), "independent", F.lit(True).alias("there"))
    rows = own.join(n, "id").join(state, "memory_id", "left")
    late = (F.col("tier") == "interpretation") & (F.col("reviewed_at").isNull() | (F.col("reviewed_at") < lives.NOW - 30 * DAY))
    issues = F.filter(F.array(F.when(F.col("there").isNull(), "missing"), F.when(F.col("forgotten_at").isNotNull(), "forgotten"), F.when(late, "stale_interpretation"), F.when((F.col("sensitive") | F.col("source_sensitive")) & (F.col("independent") < 1), "insufficient_corroboration")), lambda x: x.isNotNull())
    found = found.unionByName(rows.select("id", F.explode(issues).alias("issue")))
    bare = n.where("sensitive").join(own, "id", "left_anti").select("id", F.lit("missing_evidence").alias("issue"))
    return found.unionByName(bare).groupBy("id", "issue").agg(F.count("*").alias("n"))


def accounts_listed(spark, sf):
    """The current narrative of each scope, newest versions first; a stale one's text is withheld."""
    order = W.partitionBy("scope").orderBy("created_at", "id")
    rows = accounts(spark, sf).withColumns({"superseded_by": F.lead("id").over(order), "version": F.row_number().over(order)})
    stale = account_issues(spark, sf).select("id").distinct().withColumn("stale", F.lit(True))
    now = rows.where("superseded_by is null").join(stale, "id", "left")
    return now.select("scope", "id", "version", F.coalesce("stale", F.lit(False)).alias("stale"), F.when(F.col("stale").isNull(), F.concat(F.lit("account "), "id")).alias("text"))


def account_reviews(spark, sf):
    """Reviews of narratives: only the current version of a scope without live issues may be reviewed."""
    rows = accounts_listed(spark, sf).select("id", "stale", F.lit(True).alias("current"))
    every = accounts(spark, sf).select("id").join(rows, "id", "left")
    answer = F.when(F.col("current").isNull(), "superseded").when(F.col("stale"), "unresolved").otherwise("reviewed")
    return every.groupBy(answer.alias("answer")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (ledger_answers, ledger_states, ledger_view_as_of, ledger_view_now, claims_recalled, ledger_clock, claims_of_source, account_issues, accounts_listed, account_reviews)}

E = "floor(epoch({}))::bigint"
# What each command's answer is, worked out from times rather than replayed: a claim ends at its first withdrawal or its revision.
LEDGER = f"""cl as (select o_orderkey as id, o_orderpriority as scope, o_orderkey % 9 = 0 as sensitive, {E.format('o_orderdate')} as od, o_orderstatus as s from orders),
src as (select p_partkey as memory_id, case when p_size = 13 then {GONE}::bigint end as gone_at, p_size % 7 = 0 as msens, p_partkey % 2 = 0 as corr, case when p_size % 11 = 3 then {STALE}::bigint end as stale_at from part),
e0 as (select l_orderkey as c, greatest({E.format('l_shipdate')}, od) as tt, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {E.format('l_shipdate')}) as eid, l_partkey as m, case l_returnflag when 'A' then 'supports' when 'R' then 'challenges' else 'context' end as stance, case when l_suppkey % 7 <> 0 then l_suppkey end as origin,
  case when l_linestatus = 'O' then greatest({E.format('l_shipdate')}, od) + {30 * DAY} end as ret, gone_at, msens, corr, stale_at, sensitive from lineitem join cl on cl.id = l_orderkey join src on src.memory_id = l_partkey),
e1 as (select *, case when gone_at <= tt then 'denied_forgotten' when m % 19 = 0 then 'denied_quote' end as no from e0),
e2 as (select *, coalesce(no, case when exists (select 1 from e1 x where x.c = e1.c and x.m = e1.m and x.stance = e1.stance and x.no is null and (x.tt, x.eid) < (e1.tt, e1.eid) and (x.ret is null or x.ret > e1.tt or (x.ret = e1.tt and false))) then 'same' end) as ans from e1),
ok as (select * from e2 where ans is null),
-- times at which a claim might be adopted: its own commands and a revision that names it
tm as (select id as c, od + {100 * DAY} as t, 'adopt' as op, null::bigint as old from cl where s <> 'P' union all select id, od + {160 * DAY}, 'adopt', null from cl where id % 4 = 0 union all select n.id, o.od + {150 * DAY}, 'revise', o.id from cl o join cl n on n.id = o.id + 1 where o.id % 10 = 0),
hd as (select tm.c, tm.t, tm.op, tm.old, case when bool_or(gone_at <= t) then 'redacted' when bool_or((sensitive or msens) and not corr and (ret is null or ret > t)) then 'corroboration' when bool_or(stale_at <= t and (ret is null or ret > t)) then 'stale' when not coalesce(bool_or(stance = 'supports' and (ret is null or ret > t)), false) then 'support' end as why
  from tm left join ok on ok.c = tm.c and ok.tt <= tm.t group by all),
wd as (select id as c, min(t) as t from (select id, od + {120 * DAY} as t from cl where s = 'P' union all select id, od + {140 * DAY} from cl where id % 11 = 0) group by 1),
rv as (select o.id as old, n.id as new, o.od + {150 * DAY} as t, case
    when wd.t <= o.od + {150 * DAY} or not exists (select 1 from hd where hd.c = o.id and hd.op = 'adopt' and hd.why is null and hd.t < o.od + {150 * DAY}) then 'denied_status'
    when n.id is null or n.od > o.od + {150 * DAY} or exists (select 1 from hd where hd.c = n.id and hd.op = 'adopt' and hd.why is null and hd.t <= o.od + {150 * DAY} and (nw.t is null or nw.t >= hd.t)) or nw.t < o.od + {150 * DAY} then 'denied_replacement'
    when n.scope <> o.scope then 'denied_scope' when (select why from hd where hd.c = n.id and hd.op = 'revise') is not null then 'denied_' || (select why from hd where hd.c = n.id and hd.op = 'revise') else 'superseded' end as ans
  from cl o left join cl n on n.id = o.id + 1 left join wd on wd.c = o.id left join wd nw on nw.c = n.id where o.id % 10 = 0),
en as (select cl.id as c, least(coalesce(wd.t, 9e18::bigint), coalesce(rv.t, 9e18::bigint)) as t from cl left join wd on wd.c = cl.id left join rv on rv.old = cl.id and rv.ans = 'superseded'),
ev as (select ok.*, case when en.t < tt then 'denied_status' end as late from ok join en using (c)),
live as (select * from ev where late is null),
ans as (
  select id as c, od as tt, 0 as rk, 'create' as op, 'proposed' as answer, 'proposed' as action, null::bigint as rep, null::bigint as m from cl
  union all select e2.c, e2.tt, 1, 'evidence', case when en.t < e2.tt then 'denied_status' else coalesce(ans, 'evidence_added') end, case when ans is null and not en.t < e2.tt then 'evidence_added' end, null, e2.m from e2 join en using (c)
  union all select e0.c, e0.ret, 2, 'retract', case when live.eid is null then 'unknown_evidence' else 'evidence_retracted' end, case when live.eid is not null then 'evidence_retracted' end, null, null from e0 left join live on live.eid = e0.eid where e0.ret is not null
  union all select x.c, {GONE}, 3, 'source_changed', coalesce(max(y), 'none'), max(y), null, x.m from (select distinct cl.id as c, e0.m, case when od <= {GONE} then 1 end as made from e0 join cl on cl.id = e0.c where gone_at is not null) x left join (select live.c, live.m, 'source_changed' as y from live join en using (c) where tt <= {GONE} and (ret is null or ret > {GONE}) and en.t >= {GONE}) z on z.c = x.c and z.m = x.m where made = 1 group by x.c, x.m
  union all select x.c, {GONE}, 3, 'source_changed', 'unknown_claim', null, null, x.m from (select distinct cl.id as c, e0.m from e0 join cl on cl.id = e0.c where gone_at is not null and od > {GONE}) x
  union all select hd.c, hd.t, 4, 'adopt', case when en.t < hd.t then 'denied_status' when why is null then 'adopted' else 'denied_' || why end, case when why is null and not en.t < hd.t then 'adopted' end, null, null from hd join en using (c) where hd.op = 'adopt'
  union all select old, t, 5, 'revise', ans, case when ans = 'superseded' then ans end, case when ans = 'superseded' then new end, null from rv
  union all select new, t, 5, 'revise', 'adopted', 'adopted', null, null from rv where ans = 'superseded'
  union all select w.id, w.t, 6, 'withdraw', case when en.t < w.t then 'denied_status' else 'withdrawn' end, case when not en.t < w.t then 'withdrawn' end, null, null from (select id, od + {120 * DAY} as t from cl where s = 'P' union all select id, od + {140 * DAY} from cl where id % 11 = 0) w join en on en.c = w.id)"""


def view_sql(as_of):
    t = as_of if as_of is not None else "9e18::bigint"
    return f"""sv as (select c, arg_max(action, (tt, rk)) filter (where action in ('proposed', 'adopted', 'withdrawn', 'superseded')) as status, max((tt, rk)) filter (where action in ('proposed', 'adopted', 'withdrawn', 'superseded')) as d, max((tt, rk)) as l from ans where action is not null and tt <= {t} group by c),
pv as (select c, count(*) filter (where lv and stance = 'supports') as supporting, count(*) filter (where lv and stance = 'challenges') as challenging, count(distinct origin) filter (where lv and stance = 'supports') as origins, count(*) filter (where lv and stance = 'supports' and origin is null) as unknown_origins, count(*) filter (where lv and (((sensitive or msens) and not corr) or stale_at is not null)) as issues, bool_or(gone_at is not null) as redacted
  from (select *, tt <= {t} and (ret is null or ret > {t}) as lv from live) group by c),
vw as (select cl.id, cl.scope, cl.od, cl.sensitive, status, coalesce(supporting, 0) as supporting, coalesce(challenging, 0) as challenging, coalesce(origins, 0) as origins, coalesce(unknown_origins, 0) as unknown_origins, coalesce(redacted, false) as redacted, coalesce(redacted, false) or (status = 'adopted' and (l > d or coalesce(issues, 0) > 0 or coalesce(supporting, 0) = 0)) as review_required
  from cl join sv on sv.c = cl.id left join pv on pv.c = cl.id where cl.od <= {t})"""


SHOWN = "select id, status, supporting, challenging, origins, unknown_origins, redacted, review_required, status = 'adopted' and not review_required as eligible from vw"
ACCOUNTS = f"""nr as (select (seq // 40)::bigint as id, max(moment) as created_at, list_sort(list_distinct(list(memory_id))) as mem from commands group by 1),
na as (select id, created_at, 'n' || (id % 9) as scope, id % 4 = 1 as sensitive, id % 17 = 0 as malformed, case when id % 17 = 0 or id % 7 = 3 then [] when id % 13 = 5 then list_append(mem[1:3], 9999) else mem[1:3] end as mids, case when id % 3 = 0 then [id * 3, id * 3 + 1, case when id % 6 = 0 then 1000000000 else id * 3 + 2 end] else [] end as cids, id % 5 = 0 as linked from nr),
cd as (select na.id, x.c, vw.id is null as missing, coalesce(vw.status = 'adopted' and not review_required, false) as usable, coalesce(vw.sensitive, false) as cs from (select id, unnest(cids) as c from na) x join na using (id) left join vw on vw.id = x.c),
ln as (select *, row_number() over (order by opened, from_id, to_id, relation) as link from lr),
lk as (select na.id, ln.* from na left join ln on ln.link = na.id where linked),
nb as (select na.*, sensitive or coalesce((select bool_or(cs) from cd where cd.id = na.id), false) as sens2 from na),
ow as (select distinct id, m from (select id, unnest(mids) as m from na union all select id, unnest([from_id, to_id]) from lk where from_id is not null)),
iss as (select id, 'invalid_memory_ids' as issue from na where malformed union all select id, case when missing then 'missing_claim' else 'unusable_claim' end from cd where missing or not usable union all select id, 'unusable_relationship' from lk where opened is null or closed is not null
  union all select ow.id, 'missing' from ow left join fin on fin.memory_id = m where fin.memory_id is null union all select ow.id, 'forgotten' from ow join fin on fin.memory_id = m where forgotten is not null
  union all select ow.id, 'stale_interpretation' from ow join fin on fin.memory_id = m where tier = 'interpretation' and (reviewed is null or reviewed < {lives.NOW - 30 * DAY}) union all select ow.id, 'insufficient_corroboration' from ow join nb on nb.id = ow.id join fin on fin.memory_id = m where (sens2 or sens) and independent < 1
  union all select id, 'missing_evidence' from nb where sens2 and not exists (select 1 from ow where ow.id = nb.id))"""
ALL = f"with recursive {M.COMMANDS}, {lives.ACTS}, {lives.LINKS}, {LEDGER}, {view_sql(None)}, {ACCOUNTS}"
LISTED = "cur as (select scope, id, row_number() over (partition by scope order by created_at, id) as version, lead(id) over (partition by scope order by created_at, id) as nxt from na), li as (select scope, id, version::int as version, exists (select 1 from iss where iss.id = cur.id) as stale from cur where nxt is null)"
ORACLE = {
    "ledger_answers": f"with {LEDGER} select op, answer, count(*) as n, sum(c)::bigint as ids, sum(tt)::bigint as times from ans group by all",
    "ledger_states": f"""with {LEDGER} select c as claim_id, tt as "at", action, rep as replacement_id from ans where action in ('proposed', 'adopted', 'withdrawn', 'superseded')""",
    "ledger_view_as_of": f"with {LEDGER}, {view_sql(AS_OF)} {SHOWN}",
    "ledger_view_now": f"with {LEDGER}, {view_sql(None)} {SHOWN}",
    "claims_recalled": f"""with {LEDGER}, {view_sql(AS_OF)}, rr as (select vw.id, od, coalesce(d.text, '') as content from vw join documents d on d.doc_id = vw.id % (select count(*) from documents) where status = 'adopted' and not review_required and scope = '2-HIGH' and (vw.id % 3 = 0 or od <= {VALID_AT}) and (vw.id % 2 = 1 or {VALID_AT} < od + {900 * DAY})),
q as (select 0 as qid, '{QUERY}' as query), {bm25_sql('rr', 'q')} select row_number() over (order by coalesce(relevance, 0) desc, od desc, rr.id)::int as rank, rr.id, coalesce(relevance, 0) as relevance, (select count(*) from rr) as eligible_count, (select count(*) from rr) > 10 as truncated from rr left join scores on scores.id = rr.id qualify rank <= 10""",
    "ledger_clock": f"with {LEDGER} select id, max(od) over (partition by scope order by id) as ledger_time from cl",
    "claims_of_source": f"with {LEDGER} select m as memory_id, count(*) as claims, min(c) as first_claim from ans where answer = 'source_changed' group by m",
    "account_issues": f"{ALL} select id, issue, count(*) as n from iss group by all",
    "accounts_listed": f"{ALL}, {LISTED} select scope, id, version, stale, case when not stale then 'account ' || id end as text from li",
    "account_reviews": f"{ALL}, {LISTED} select case when li.id is null then 'superseded' when stale then 'unresolved' else 'reviewed' end as answer, count(*) as n from na left join li on li.id = na.id group by 1",
}

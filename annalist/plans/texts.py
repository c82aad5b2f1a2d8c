"""Queries of the text functions, over phrases and whole tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.functions import vocab as V
from annalist.operators.governance import pairs
from annalist.sources import model as M
from annalist.sources.phrases import phrases, phrases_sql

def content():
    return F.col("content")


def said(spark, sf):
    """All turns and the phrases, whose ids and sessions are negative."""
    more = phrases(spark).withColumn("moment", F.col("session_id") * 100 + F.col("position"))
    return M.turns(spark, sf).unionByName(more.withColumns({"id": -F.col("id"), "session_id": -F.col("session_id")}))


def normalize_dedup(spark, sf):
    keyed = M.materials(spark, sf).groupBy(F.sha2(T.normal(content()), 256).alias("key"))
    return keyed.agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("first_id", "copies")


def normal_keys(spark, sf):
    return said(spark, sf).select("id", T.normal(content()).alias("key"))


def injection_flags(spark, sf):
    rows = M.materials(spark, sf).select("id", "content").unionByName(phrases(spark).select((-F.col("id")).alias("id"), "content"))
    return rows.select("id", T.injection(content()).alias("shape")).where("shape is not null")


def negation_profile(spark, sf):
    rows = M.turns(spark, sf).select("source", "content").unionByName(phrases(spark).select("source", "content"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(T.negated(content())).alias("negated"))


def latin_ratio(spark, sf):
    return M.materials(spark, sf).groupBy("frame").agg(F.count("*").alias("n"), F.count_if(T.latin(content())).alias("latin"))


def stem_shared_tokens(spark, sf):
    s = T.stems(content())
    rows = M.turns(spark, sf).select("id", "session_id", "position", s.alias("stems"))
    before = F.lag("stems").over(W.partitionBy("session_id").orderBy("position"))
    return rows.select("id", F.coalesce(F.size(F.array_intersect("stems", before)), F.lit(0)).alias("shared"))


def domains(spark, sf):
    return said(spark, sf).select("id", T.domain(content()).alias("domain"), T.latin(content()).alias("latin"), T.pronoun(content()).alias("pronoun"))


def revocations(spark, sf):
    return said(spark, sf).select("id", T.revoked(content()).alias("revoked"), T.changed(content()).alias("changed"), T.negated(content()).alias("negated"), T.is_rule(content()).alias("is_rule"))


def opposite_pairs(spark, sf):
    """Statements of a session, at most 300 apart, that say opposite things: the earlier, the later, and what they are about."""
    found = pairs(said(spark, sf), "session_id")
    return found.select(F.col("old.id").alias("a"), F.col("new.id").alias("b"), T.opposite(F.col("old.content"), F.col("new.content")).alias("pair")).where("pair is not null")


def triple_keys(spark, sf):
    return said(spark, sf).select("id", T.triple_key(content()).alias("key")).where("key is not null")


def content_years(spark, sf):
    return said(spark, sf).select("id", F.posexplode(T.years(content())).alias("n", "year"))


def stem_rows(spark, sf):
    return said(spark, sf).select("id", F.explode(T.stems(content())).alias("stem"))


def token_rows(spark, sf):
    return said(spark, sf).select("id", F.posexplode(T.tokens(content())).alias("n", "token"))


def chunk_sentences(spark, sf):
    return M.materials(spark, sf).select("id", F.posexplode(T.chunks(content())).alias("n", "chunk")).select("id", "n", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


def summary_points(spark, sf):
    rows = M.turns(spark, sf).select("id", "content").unionByName(phrases(spark).select((-F.col("id")).alias("id"), "content"))
    return rows.select("id", T.point(content()).alias("point"))


def rolling_summary(spark, sf):
    points = M.turns(spark, sf).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("position", T.point(content()).alias("point")))).alias("p"))
    summary = T.rolled(F.col("p.point"))
    return points.select("session_id", F.length(summary).alias("n_chars"), F.md5(summary).alias("summary_md5"))


QUERIES = {f.__name__: f for f in (normalize_dedup, normal_keys, injection_flags, negation_profile, latin_ratio, stem_shared_tokens, domains, revocations, opposite_pairs, triple_keys, content_years, stem_rows, token_rows, chunk_sentences, summary_points, rolling_summary)}


# DuckDB forms: word patterns with explicit boundaries, lists of parts as alternatives.
def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(column: str, words: str) -> str:
    return f"regexp_matches({column}, {q('(?i)(^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])(?:' + words + ')($|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])')})"


def part(column: str, listed: str) -> str:
    return "(" + " or ".join(f"contains({column}, {q(w)})" for w in listed.split()) + ")"


def negated(c: str) -> str:
    return f"({part(c, V.NEGATION_PARTS)} or len(list_filter(regexp_extract_all(lower({c}), '[a-z'']+'), lambda w: w in ({', '.join(map(q, V.NEGATION_WORDS))}) or ends_with(w, 'n''t'))) > 0)"


def domain(c: str) -> str:
    return "case " + " ".join(f"when {part(c, p)} then {q(d)}" for d, p in V.DOMAIN_PARTS.items()) + " " + " ".join(f"when {has(c, p)} then {q(d)}" for d, p in V.DOMAIN_WORDS.items()) + " end"


def latin(c: str) -> str:
    letters = rf"length(regexp_replace({c}, '[^\p{{L}}]', '', 'g'))"
    return f"coalesce({letters} > 0 and length(regexp_replace({c}, '[^A-Za-z]', '', 'g')) / {letters} >= 0.8, false)"


def revoked(c: str) -> str:
    return f"(({domain(c)}) is not null and (((contains({c}, '了') or contains({c}, '再')) and {part(c, V.REVOKE_PARTS)}) or {has(c, V.REVOKE_WORDS)} or ({has(c, V.MARKER_WORDS)} and {negated(c)})))"


def changed(c: str) -> str:
    return f"({revoked(c)} or {part(c, V.CHANGE_PARTS)} or {has(c, V.MARKER_WORDS)} or {has(c, V.CHANGE_WORDS)} or {has(c, V.REVOKE_WORDS)})"


def content_words(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z]+'), lambda w: length(w) >= 3 and w not in ({', '.join(map(q, V.CONTENT_STOP))})))"


def stems(c: str) -> str:
    return f"list_distinct(list_transform({content_words(c)}, lambda w: case when ends_with(w, 'ies') and length(w) > 4 then left(w, -3) || 'y' when ends_with(w, 's') and length(w) > 3 and not regexp_matches(w, '(ss|us|is|as|sh|ch|x|z)$') then left(w, -1) else w end))"


def opposite(a: str, b: str) -> str:
    chinese = [f"when (contains({a}, {q(x)}) and contains({b}, {q(y)})) or (contains({a}, {q(y)}) and contains({b}, {q(x)})) then {q(x + '/' + y)}" for x, y in V.OPPOSITE_PARTS]
    english = [f"when ({has(a, x)} and {has(b, y)}) or ({has(a, y)} and {has(b, x)}) then 'en-opposite'" for x, y in V.OPPOSITE_WORDS]
    return "case " + " ".join(chinese + english) + " end"


def pronoun(c: str) -> str:
    return f"list_filter(list_slice(regexp_extract_all(lower({c}), '[a-z]+'), 1, 4), lambda w: w in ({', '.join(map(q, V.PRONOUNS))}))[1]"


def triple_key(c: str) -> str:
    def key(a: str, b: str) -> str:
        pattern = rf'"{a}"\s*:\s*"([^"]+)"\s*,\s*"{b}"\s*:\s*"([^"]+)"'
        return f"case when regexp_matches({c}, {q(pattern)}) then lower(regexp_extract({c}, {q(pattern)}, 1) || chr(9) || regexp_extract({c}, {q(pattern)}, 2)) end"

    return f"case when contains({c}, '\"subject\"') then coalesce({key('subject_id', 'relation_id')}, {key('subject', 'relation')}) end"


def normal(c: str) -> str:
    return rf"replace(lower(trim(regexp_replace({c}, '[\s\p{{Z}}]+', ' ', 'g'))), 'ß', 'ss')"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def point(c: str) -> str:
    greeting = q(V.GREETING)
    return rf"""(select case when length(h) <= 160 then h else regexp_replace(left(h, 160), '[\s\p{{Z}}]+$', '') || '…' end from (select coalesce(list_filter(l, lambda x: not regexp_matches(x, {greeting}) or length(x) >= 12)[1], l[1], '') as h
  from (select list_filter(list_transform(string_split({strip(c)}, chr(10)), lambda x: {strip('x')}), lambda x: length(x) > 0) as l)))"""


P = phrases_sql()
SAID = f"{M.TURNS}, {P}, said as (select id, session_id, position, source, content, moment from turns union all select -id, -session_id, position, source, content, session_id * 100 + position from phrases)"
BOTH = f"with {M.TURNS}, {M.MATERIALS}, {P}"
def chunk_sql(rows: str) -> str:
    """CTEs ending in chunks (id, n, chunk) of a relation (id, content), in a recursive query."""
    blank = r"'^[\s\p{Z}]+|[\s\p{Z}]+$'"
    return rf"""p_ as (select id, content, list_filter(regexp_extract_all(content, '[^。！？；.!?\n]*[。！？；.!?\n]|[^。！？；.!?\n]+$'), lambda s: length(regexp_replace(s, '[\s\p{{Z}}]+', '', 'g')) > 0 or contains(s, chr(10))) as s from {rows}),
f_ as (select id, s, 0 as k, []::varchar[] as done, '' as now from p_ where length(content) > 1200 and len(s) > 1
  union all select id, s, k + 1, case when length(now) + length(s[k + 1]) > 1200 and length(now) >= 200 then list_append(done, now) else done end, case when length(now) + length(s[k + 1]) > 1200 and length(now) >= 200 then s[k + 1] else now || s[k + 1] end from f_ where k < len(s)),
c_ as (select id, list_filter(list_transform(list_append(done, now), lambda x: regexp_replace(x, {blank}, '', 'g')), lambda x: length(x) > 0) as c from f_ where k = len(s) union all select id, [content] from p_ where not (length(content) > 1200 and len(s) > 1)),
u_ as (select id, c, unnest(range(0, len(c))) as n from c_), chunks as (select id, n, c[n + 1] as chunk from u_)"""


def summary_sql(rows: str, key: str, order: str) -> str:
    """CTEs ending in summaries (key, summary, n) of a relation with content, one point after the other."""
    return f"""s_ as (select {key} as key_, row_number() over (partition by {key} order by {order}) as k, {point('r.content')} as pt from {rows} r),
g_ as (select distinct key_, 0::bigint as k, '' as acc from s_
  union all select key_, s_.k, case when pt = '' or list_contains(string_split(acc, chr(10)), pt) then acc when length(t) <= 4000 then t else substring(t, 1, 1600) || chr(10) || '…' || chr(10) || right(t, 2397) end
  from (select g_.key_, g_.k + 1 as k, acc, s_.pt, case when acc = '' then s_.pt else acc || chr(10) || s_.pt end as t from g_ join s_ on s_.key_ = g_.key_ and s_.k = g_.k + 1) s_),
summaries as (select key_ as {key}, arg_max(acc, k) as summary, max(k) as n from g_ group by key_)"""


ORACLE = {
    "normalize_dedup": f"with {M.MATERIALS} select min(id) as first_id, count(*) as copies from materials group by {normal('content')} having count(*) > 1",
    "normal_keys": f"with {SAID} select id, {normal('content')} as key from said",
    "injection_flags": f"{BOTH}, r as (select id, content from materials union all select -id, content from phrases), s as (select id, case {' '.join(f'when regexp_matches(content, {q(p)}) then {k}' for k, p in enumerate(V.INJECTIONS, 1))} end::int as shape from r) select * from s where shape is not null",
    "negation_profile": f"{BOTH}, r as (select source, content from turns union all select source, content from phrases) select source, count(*) as n, count(*) filter (where {negated('content')}) as negated from r group by source",
    "latin_ratio": f"with {M.MATERIALS} select frame, count(*) as n, count(*) filter (where {latin('content')}) as latin from materials group by frame",
    "stem_shared_tokens": f"with {M.TURNS}, s as (select id, session_id, position, {stems('content')} as st from turns) select id, coalesce(len(list_intersect(st, lag(st) over (partition by session_id order by position))), 0)::int as shared from s",
    "domains": f"with {SAID} select id, {domain('content')} as domain, {latin('content')} as latin, {pronoun('content')} as pronoun from said",
    "revocations": f"with {SAID} select id, {revoked('content')} as revoked, {changed('content')} as changed, {negated('content')} as negated, (regexp_matches(content, {q(V.RULE_PARTS)}) or {has('content', V.RULE_WORDS)}) as is_rule from said",
    "opposite_pairs": f"with {SAID}, p as (select *, row_number() over (partition by session_id order by moment, position, id) as place from said), r as (select x.id as a, y.id as b, {opposite('x.content', 'y.content')} as pair from p x join p y on x.session_id = y.session_id and x.place < y.place and y.place - x.place <= 300) select * from r where pair is not null",
    "triple_keys": f"with {SAID}, r as (select id, {triple_key('content')} as key from said) select * from r where key is not null",
    "content_years": rf"with {SAID}, r as (select id, regexp_extract_all(content, '(20\d\d)年|(?i:in|during) (?i:the year )?(20\d\d)') as m from said), u as (select id, m, generate_subscripts(m, 1) - 1 as n from r where len(m) > 0) select id, n::int as n, regexp_extract(m[n + 1], '(20\d\d)', 1)::int as year from u",
    "stem_rows": f"with {SAID} select id, unnest({stems('content')}) as stem from said",
    "chunk_sentences": f"with recursive {M.MATERIALS}, {chunk_sql('materials')} select id, n::int as n, length(chunk)::int as n_chars, md5(chunk) as chunk_md5 from chunks",
    "rolling_summary": f"with recursive {M.TURNS}, {summary_sql('turns', 'session_id', 'position')} select session_id, length(summary)::int as n_chars, md5(summary) as summary_md5 from summaries",
    "summary_points": f"{BOTH}, r as (select id, content from turns union all select -id, content from phrases) select id, {point('r.content')} as point from r",
}
from annalist.plans.retrieval import tok  # noqa: E402

ORACLE["token_rows"] = f"with {SAID}, r as (select id, {tok('content')} as t from said), u as (select id, t, unnest(range(0, len(t))) as n from r) select id, n::int as n, t[n + 1] as token from u"

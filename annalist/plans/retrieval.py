"""Queries of lexical, vector and fused retrieval, the recall cascade, archive and timeline views."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import vocab as V
from annalist.operators.expand import cascade
from annalist.operators.lexical import bm25, ranked, tokenized, top, top_each
from annalist.operators.selection import foremost
from annalist.operators.vector import fused, nearest, similarities
from annalist.sources import model as M

QUERY = "thing ther that than oner der schen que tion"


def tok(column: str) -> str:
    """DuckDB form of the tokenizer."""
    stop = ", ".join(f"'{w}'" for w in V.STOP_WORDS)
    return rf"""flatten(list_transform(regexp_extract_all({column}, '[A-Za-z0-9_]+|[\x{{4e00}}-\x{{9fff}}]+'), lambda x:
      case when regexp_matches(x, '^[A-Za-z0-9_]') then case when length(x) > 1 and lower(x) not in ({stop}) then [lower(x)] else []::varchar[] end
           when length(x) = 1 then [x] else list_transform(range(1, length(x)), lambda i: substring(x, i::int, 2)) end))"""


def bm25_sql(rows: str, queries: str) -> str:
    """CTEs ending in scores (qid, id, relevance) for a relation rows (id, content) and queries (qid, query)."""
    return f"""d_ as (select id, {tok('content')} as t from {rows}),
s_ as (select count(*) as n, case when avg(len(t)) > 0 then avg(len(t)) else 1 end as avgdl from d_),
w_ as (select distinct qid, unnest({tok('query')}) as term from {queries}),
p_ as (select id, len(t) as dl, unnest(t) as term from d_),
f_ as (select term, id, dl, count(*) as tf from p_ where term in (select term from w_) group by all),
g_ as (select term, count(*) as df from f_ group by 1),
scores as (select qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) as relevance
  from f_ join g_ using (term) join w_ using (term), s_ group by qid, id)"""


FIXED = f"q as (select 0 as qid, '{QUERY}' as query)"


def bm25_topk(spark, sf):
    return top(bm25(M.tokens(spark, sf, "turns"), spark.createDataFrame([(0, QUERY)], "qid long, query string")), 20, F.desc("relevance"), "id").select("rank", "id", "relevance")


def bm25_all_relevance(spark, sf):
    return ranked(M.tokens(spark, sf, "turns"), QUERY).select("id", "relevance")


def bm25_frame_scoped(spark, sf):
    return top(ranked(M.materials(spark, sf).where("frame = 'de'"), QUERY), 15, F.desc("relevance"), "id").select("rank", "id", "relevance")


def bm25_batch_queries(spark, sf):
    queries = M.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return foremost(M.tokens(spark, sf, "materials"), queries, 5)


def recency_rank(spark, sf):
    return top(M.turns(spark, sf), 25, F.desc("moment"), F.desc("id")).select("rank", "id", "moment")


def tokenize_counts(spark, sf):
    return tokenized(M.turns(spark, sf)).select("id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def token_top_terms(spark, sf):
    terms = tokenized(M.materials(spark, sf)).select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return top(terms, 50, F.desc("df"), "term").select("rank", "term", "df")


def vectors(spark, sf):
    return M.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def semantic_topk(spark, sf):
    return top(similarities(vectors(spark, sf), 0), 20, F.desc("similarity"), "id").select("rank", "id", "similarity")


def hybrid_rrf(spark, sf):
    rows = top(ranked(M.tokens(spark, sf, "materials"), QUERY), 300, F.desc("relevance"), "id").drop("rank")  # the candidate cap
    joined = rows.join(similarities(vectors(spark, sf), 0), "id", "left").select("id", "relevance", "similarity")
    return top(fused(joined), 20, F.desc_nulls_last("search_score"), "lexical_rank").select("rank", "id", "relevance", "similarity", "search_score")


def semantic_gate(spark, sf):
    joined = ranked(M.tokens(spark, sf, "materials"), QUERY).join(similarities(vectors(spark, sf), 0), "id")
    return joined.where((F.col("relevance") > 0) | (F.col("similarity") >= V.SEMANTIC_MIN)).select("id", "relevance", "similarity")


def same_label_rate(spark, sf):
    """How many of the ten nearest vectors have the label of a query; queries are the vectors whose id is divisible by 100."""
    v = vectors(spark, sf)
    pairs = nearest(v, v.where("id % 100 = 0"), 10)
    return top_each(pairs, "qid", 10, F.desc_nulls_last("similarity"), "id").groupBy("qid").agg(F.sum("same").alias("n_same"))


def sections(spark, sf):
    rows = M.turns(spark, sf)
    anchor, canon = "session_id % 37 = 5 and position = 0", "session_id % 41 = 7 and position = 1"
    return rows.withColumn("section", F.when(F.expr(anchor), "anchor").when(F.expr(canon), "canon").otherwise("ordinary"))


def recall_cascade(spark, sf):
    rows = sections(spark, sf)
    scored = ranked(rows.where("section = 'ordinary'"), QUERY).select("id", "section", "moment", "relevance").unionByName(rows.where("section <> 'ordinary'").select("id", "section", "moment", F.lit(0.0).alias("relevance")))
    return cascade(scored, 20).select("section", "rank", "id", "relevance")


def archive_search(spark, sf):
    rows = M.turns(spark, sf).where(f"source = 'user' and moment >= {M.EPOCH + 36000}")
    out = top(ranked(rows, QUERY), 10, F.desc("relevance"), F.desc("moment"), "id")
    n = rows.agg(F.count("*").alias("eligible"))
    return out.join(F.broadcast(n)).select("rank", "id", "relevance", "eligible", (F.col("eligible") > 10).alias("truncated"))


def with_unknown(rows):
    """Every eleventh turn has no known time."""
    return rows.withColumn("event_at", F.when(F.col("id") % 11 != 0, F.col("moment")))


def timeline(spark, sf):
    rows = with_unknown(M.turns(spark, sf))
    return top(rows, 60, F.asc_nulls_last("event_at"), "moment", "id").select("rank", "id", "event_at")


def time_window_filter(spark, sf):
    since, until = M.EPOCH + 7200, M.EPOCH + 100 * 3600
    rows = with_unknown(M.turns(spark, sf))
    return rows.groupBy("source").agg(F.sum(F.when(F.col("event_at").between(since, until), 1).otherwise(0)).alias("inside"), F.count_if(F.col("event_at").isNull()).alias("unknown"))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_all_relevance, bm25_frame_scoped, bm25_batch_queries, recency_rank, tokenize_counts, token_top_terms, semantic_topk, hybrid_rrf, semantic_gate, same_label_rate, recall_cascade, archive_search, timeline, time_window_filter)}

SIM = "sims as (select e.vec_id as id, round(list_cosine_similarity(e.embedding::double[], o.embedding::double[]), 6) as similarity from embeddings e, (select embedding from embeddings where vec_id = 0) o)"
SECTIONS = "sec as (select *, case when session_id % 37 = 5 and position = 0 then 'anchor' when session_id % 41 = 7 and position = 1 then 'canon' else 'ordinary' end as section from turns)"
ORACLE = {
    "bm25_topk": f"with {M.TURNS}, {FIXED}, {bm25_sql('turns', 'q')} select row_number() over (order by relevance desc, id)::int as rank, id, relevance from scores qualify rank <= 20",
    "bm25_all_relevance": f"with {M.TURNS}, {FIXED}, {bm25_sql('turns', 'q')} select t.id, coalesce(relevance, 0) as relevance from turns t left join scores s on t.id = s.id",
    "bm25_frame_scoped": f"with {M.MATERIALS}, r as (select * from materials where frame = 'de'), {FIXED}, {bm25_sql('r', 'q')} select row_number() over (order by coalesce(relevance, 0) desc, r.id)::int as rank, r.id, coalesce(relevance, 0) as relevance from r left join scores on r.id = scores.id qualify rank <= 15",
    "bm25_batch_queries": f"with {M.MATERIALS}, q as (select item_id as qid, text as query from benchmark), {bm25_sql('materials', 'q')} select qid, row_number() over (partition by qid order by relevance desc, id)::int as rank, id, relevance from scores qualify rank <= 5",
    "recency_rank": f"with {M.TURNS} select row_number() over (order by moment desc, id desc)::int as rank, id, moment from turns qualify rank <= 25",
    "tokenize_counts": f"with {M.TURNS}, t as (select id, {tok('content')} as k from turns) select id, len(k)::int as n_tokens, len(list_distinct(k))::int as n_distinct, md5(array_to_string(k, ' ')) as tokens_md5 from t",
    "token_top_terms": f"with {M.MATERIALS}, t as (select id, unnest(list_distinct({tok('content')})) as term from materials), g as (select term, count(*) as df from t group by 1) select row_number() over (order by df desc, term)::int as rank, term, df from g qualify rank <= 50",
    "semantic_topk": f"with {SIM} select row_number() over (order by similarity desc, id)::int as rank, id, similarity from sims qualify rank <= 20",
    "hybrid_rrf": f"""with {M.MATERIALS}, {FIXED}, {bm25_sql('materials', 'q')}, {SIM},
c as (select m.id, coalesce(relevance, 0) as relevance from materials m left join scores s on m.id = s.id order by 2 desc, 1 limit 300),
a as (select c.*, similarity, row_number() over (order by relevance desc, c.id) as lx from c left join sims on sims.id = c.id),
b as (select *, case when similarity is not null then row_number() over (order by similarity desc nulls last, lx) end as sm from a),
f as (select *, round(1.0::double / (60 + lx) + 1.0::double / (60 + sm), 8) as search_score from b)
select row_number() over (order by search_score desc nulls last, lx)::int as rank, id, relevance, similarity, search_score from f qualify rank <= 20""",
    "semantic_gate": f"with {M.MATERIALS}, {FIXED}, {bm25_sql('materials', 'q')}, {SIM} select m.id, coalesce(relevance, 0) as relevance, similarity from materials m left join scores s on m.id = s.id join sims on sims.id = m.id where coalesce(relevance, 0) > 0 or similarity >= 0.85",
    "same_label_rate": """with p as (select q.vec_id as qid, e.vec_id as id, (e.label = q.label)::int as same, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as similarity from embeddings e join embeddings q on q.vec_id % 100 = 0 and e.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by qid order by similarity desc, id) as n from p) select qid, sum(same)::bigint as n_same from r where n <= 10 group by qid""",
    "recall_cascade": f"""with {M.TURNS}, {SECTIONS}, o as (select id, content from sec where section = 'ordinary'), {FIXED}, {bm25_sql('o', 'q')},
n as (select count(*) filter (where section = 'anchor') as a, count(*) filter (where section = 'canon') as c from sec),
r as (select section, sec.id, coalesce(relevance, 0) as relevance, row_number() over (partition by section order by case when section = 'ordinary' then coalesce(relevance, 0) else 0 end desc, case when section = 'ordinary' then -moment else moment end, sec.id)::int as rank from sec left join scores on sec.id = scores.id)
select section, rank, id, relevance from r, n where section = 'anchor' or (section = 'canon' and rank <= greatest(20 - a, 0)) or (section = 'ordinary' and rank <= greatest(20 - a - least(c, greatest(20 - a, 0)), 0))""",
    "archive_search": f"""with {M.TURNS}, r as (select * from turns where source = 'user' and moment >= {M.EPOCH + 36000}), {FIXED}, {bm25_sql('r', 'q')}
select row_number() over (order by coalesce(relevance, 0) desc, moment desc, r.id)::int as rank, r.id, coalesce(relevance, 0) as relevance, (select count(*) from r) as eligible, (select count(*) from r) > 10 as truncated from r left join scores on r.id = scores.id qualify rank <= 10""",
    "timeline": f"with {M.TURNS}, t as (select *, case when id % 11 <> 0 then moment end as event_at from turns) select row_number() over (order by event_at nulls last, moment, id)::int as rank, id, event_at from t qualify rank <= 60",
    "time_window_filter": f"with {M.TURNS}, t as (select *, case when id % 11 <> 0 then moment end as event_at from turns) select source, count(*) filter (where event_at >= {M.EPOCH + 7200} and event_at <= {M.EPOCH + 360000}) as inside, count(*) filter (where event_at is null) as unknown from t group by source",
}

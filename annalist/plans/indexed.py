"""Queries from a stored index: token caches, exact top k by block maxima, an index that grows."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.plans.relations import STATED, stated
from annalist.plans.retrieval import bm25_sql, tok
from annalist.sources import model as M
from annalist.sources import postings
from annalist.sources.store import fingerprint, shared_folder


def with_caches(spark, sf):
    """Stored statements: of five one has no token cache, one a broken one, one a list that isn't of strings alone, one its tokens
    and one tokens that were right once."""
    rows = stated(spark, sf)
    kind = F.pmod("id", F.lit(5))
    cache = F.when(kind == 1, "{broken").when(kind == 2, '["a", 1]').when(kind == 3, F.to_json(T.tokens(F.col("content")))).when(kind == 4, '["once", "right"]')
    return rows.withColumn("content_tokens", cache)


def token_caches(spark, sf):
    words = postings.cached_tokens(F.col("content"), F.col("content_tokens"))
    return with_caches(spark, sf).withColumn("t", words).select("id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def index(spark, sf, parts):
    """The index of all documents, in so many generations; built once for each state of the table."""
    source = f"{sf}/documents.parquet"
    path = f"{shared_folder(spark)}/postings-{parts}-{fingerprint(spark, source)}"
    for k in range(parts):
        if not postings.complete(spark, path, str(k)):
            postings.add(M.materials(spark, sf).where(F.pmod("id", F.lit(parts)) == k) if parts > 1 else M.materials(spark, sf), path, str(k))
    return path


def benchmark_queries(spark, sf):
    return M.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def indexed_topk(spark, sf):
    """The five best documents of every benchmark item."""
    return postings.search(spark, index(spark, sf, 1), benchmark_queries(spark, sf), 5)


def indexed_growth(spark, sf):
    """The same from an index to which documents were added in three parts: statistics are those of all."""
    return postings.search(spark, index(spark, sf, 3), benchmark_queries(spark, sf), 5)


QUERIES = {f.__name__: f for f in (token_caches, indexed_topk, indexed_growth)}

TOPK = f"with {M.MATERIALS}, q as (select item_id as qid, text as query from benchmark), {bm25_sql('materials', 'q')} select qid, row_number() over (partition by qid order by relevance desc, id)::int as rank, id, relevance from scores qualify rank <= 5"
ORACLE = {
    "token_caches": rf"with {STATED}, t as (select id, case when ((id % 5) + 5) % 5 = 4 and not regexp_matches(content, '[\x{{4e00}}-\x{{9fff}}][A-Za-z0-9_]+[\x{{4e00}}-\x{{9fff}}]') then ['once', 'right'] else {tok('content')} end as k from stated) select id, len(k)::int as n_tokens, md5(array_to_string(k, ' ')) as tokens_md5 from t",
    "indexed_topk": TOPK,
    "indexed_growth": TOPK,
}

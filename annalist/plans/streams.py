"""Queries of the stateful stream: places of chunks, edges found as rows come, running summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.plans.relations import CONTRA, STATED, VERSIONS, near_sql, stated
from annalist.plans.texts import chunk_sql, summary_sql
from annalist.sources.store import shared_path
from annalist.streaming import history

#: Users among whom sessions are dealt out.
USERS = 97


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """All turns (and the phrases) as messages of Add requests, a request each, in the order in which they were said."""
    user = F.concat(F.lit("u"), F.pmod("session_id", F.lit(USERS)))
    arrived = F.col("moment") * 1000 + F.col("position")
    return stated(spark, sf).select(user.alias("user_id"), F.col("session_id").cast("string").alias("session_id"), F.concat(F.lit("r"), "id").alias("request_id"), F.lit(0).cast("long").alias("message"), arrived.alias("arrived"), "id", "source", "content", "moment")


def run(spark: SparkSession, sf: str) -> str:
    """The stream over a folder in which the requests have landed; gives the store."""
    landed, store = shared_path(spark, "landed"), shared_path(spark, "history")
    messages(spark, sf).write.parquet(landed)
    rows = spark.readStream.schema(history.MESSAGE).parquet(landed)
    history.start(rows, store, f"{store}/checkpoint").awaitTermination()
    return store


def stream_turns(spark, sf):
    rows = history.read(spark, run(spark, sf), "turns")
    return rows.select("id", "user_id", F.col("session_id").cast("long").alias("session_id"), "chunk", "position", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


def stream_edges(spark, sf):
    """Versions and contradictions, found when the later statement comes."""
    store = run(spark, sf)
    versions = history.read(spark, store, "versions").select(F.lit("version").alias("kind"), "old_id", "new_id", F.col("similarity").cast("string").alias("detail"))
    return versions.unionByName(history.read(spark, store, "contradictions").select(F.lit("contradiction").alias("kind"), F.col("a").alias("old_id"), F.col("b").alias("new_id"), F.col("signal").alias("detail")))


def stream_summaries(spark, sf):
    rows = history.read(spark, run(spark, sf), "summaries")
    return rows.select(F.col("session_id").cast("long").alias("session_id"), "n_messages", F.length("summary").alias("n_chars"), F.md5("summary").alias("summary_md5"))


QUERIES = {f.__name__: f for f in (stream_turns, stream_edges, stream_summaries)}

SAID = f"{STATED}, said as (select *, 'u' || (((session_id % {USERS}) + {USERS}) % {USERS}) as user_id from stated)"
ORACLE = {
    "stream_turns": f"""with recursive {SAID}, {chunk_sql('said')}, n as (select id, count(*) as n from chunks group by 1),
w as (select said.id, user_id, session_id, coalesce(sum(n) over (partition by session_id order by moment, position rows between unbounded preceding and 1 preceding), 0)::bigint as first from said join n on n.id = said.id)
select w.id, user_id, session_id, c.n::int as chunk, first + c.n as position, length(chunk)::int as n_chars, md5(chunk) as content_md5 from w join chunks c on c.id = w.id""",
    "stream_edges": f"with {SAID}, {near_sql('said', 'user_id')}, v as ({VERSIONS}), {CONTRA} select 'version' as kind, old_id, new_id, similarity::varchar as detail from v union all select 'contradiction', a, b, signal from ct where signal is not null",
    "stream_summaries": f"with recursive {SAID}, {summary_sql('said', 'session_id', 'position')} select session_id, n::bigint as n_messages, length(summary)::int as n_chars, md5(summary) as summary_md5 from summaries",
}

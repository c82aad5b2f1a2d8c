"""The data model over Parquet tables: turns, materials, commands, claims, evidence; times are epoch seconds (UTC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.sources.store import kept

#: Time of the first turn of conversation 0.
EPOCH = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as memories: id, session_id, position, source (role), content, moment."""
    at = F.lit(EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("position"), F.col("role").alias("source"), F.coalesce("text", F.lit("")).alias("content"), at.alias("moment"))


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as archive material: id, content, frame (language), source."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"), F.col("lang").alias("frame"), "source")


def tokens(spark: SparkSession, sf_dir: str, of: str) -> DataFrame:
    """The token cache of ``turns`` or ``materials``: id, tokens, their number dl, the content's bytes; written once for each state of
    the table."""
    rows, source = (turns(spark, sf_dir), "conversations") if of == "turns" else (materials(spark, sf_dir), "documents")
    words = rows.select("id", T.tokens(F.col("content")).alias("tokens"), F.octet_length("content").cast("long").alias("bytes")).withColumn("dl", F.size("tokens"))
    return kept(spark, f"sized-tokens-{of}", f"{sf_dir}/{source}.parquet", lambda: words)


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle commands: seq, memory_id, moment, op, label."""
    ops = {"signup": "remember", "click": "corroborate", "view": "review", "purchase": "promote", "error": "forget"}
    op = F.create_map(*(F.lit(x) for kv in ops.items() for x in kv))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("memory_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("moment"), op[F.col("event_type")].alias("op"), F.concat(F.lit("s"), F.get_json_object("props", "$.k")).alias("label"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims: id, scope, recorded_at, status, memory_id (customer)."""
    status = F.when(F.col("o_orderstatus") == "F", "adopted").when(F.col("o_orderstatus") == "O", "proposed").otherwise("withdrawn")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("scope"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("recorded_at"), status.alias("status"), F.col("o_custkey").alias("memory_id"), F.col("o_totalprice").alias("weight"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as evidence: claim_id, line, memory_id (part), origin_id (supplier; every seventh unknown), stance,
    recorded_at, retracted_at (30 days later where the line is open)."""
    stance = F.when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "R", "challenges").otherwise("context")
    at = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("memory_id"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("origin_id"), stance.alias("stance"), at.alias("recorded_at"), F.when(F.col("l_linestatus") == "O", at + 30 * 86400).alias("retracted_at"))


# DuckDB forms of the same tables, for the oracles.
TURNS = f"turns as (select conv_id * 1000 + turn as id, conv_id as session_id, turn as position, role as source, coalesce(text, '') as content, {EPOCH} + conv_id * 3600 + turn * 60 as moment from conversations)"
MATERIALS = "materials as (select doc_id as id, coalesce(text, '') as content, lang as frame, source from documents)"
COMMANDS = """commands as (select event_id as seq, user_id as memory_id, floor(epoch(ts))::bigint as moment, case event_type when 'signup' then 'remember' when 'click' then 'corroborate' when 'view' then 'review' when 'purchase' then 'promote' when 'error' then 'forget' end as op,
  's' || json_extract_string(props, '$.k') as label from events)"""
CLAIMS = """claims as (select o_orderkey as id, o_orderpriority as scope, floor(epoch(o_orderdate))::bigint as recorded_at, case o_orderstatus when 'F' then 'adopted' when 'O' then 'proposed' else 'withdrawn' end as status, o_custkey as memory_id, o_totalprice as weight from orders)"""
EVIDENCE = """evidence as (select l_orderkey as claim_id, l_linenumber as line, l_partkey as memory_id, case when l_suppkey % 7 <> 0 then l_suppkey end as origin_id, case l_returnflag when 'A' then 'supports' when 'R' then 'challenges' else 'context' end as stance,
  floor(epoch(l_shipdate))::bigint as recorded_at, case when l_linestatus = 'O' then floor(epoch(l_shipdate))::bigint + 30 * 86400 end as retracted_at from lineitem)"""

"""Ingestion: batch and Structured Streaming share one transformation of Add requests to stored turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from annalist.functions import text as T

REQUEST = "request_id string, user_id string, session_id string, messages array<struct<role: string, content: string, timestamp: bigint>>"


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON lines (value) to valid requests and rejected lines (value, reason)."""
    rows = lines.withColumn("r", F.from_json("value", REQUEST))
    reason = F.when(F.col("r").isNull() | F.col("r.request_id").isNull(), "malformed").when(F.trim("r.user_id") == "", "no_user").when(F.coalesce(F.size("r.messages"), F.lit(0)) < 1, "no_messages").when(F.exists("r.messages", lambda m: m["content"].isNull() | (F.trim(m["content"]) == "")), "blank_content")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").select("r.*"), rows.where("reason is not null").select("value", "reason")


def turns_of(requests: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Requests to chunked turns.  Of equal request_ids the first (by user, session and content) counts, none that ``known``
    (turns stored before) has; positions in a session go on after the known ones."""
    once = requests.withColumn("n", F.row_number().over(W.partitionBy("request_id").orderBy("user_id", "session_id", F.to_json("messages")))).where("n = 1").drop("n")
    if known is not None:
        once = once.join(known.select("request_id").distinct(), "request_id", "left_anti")
    message = once.select("request_id", "user_id", "session_id", F.posexplode("messages").alias("m", "message"))
    rows = message.select("request_id", "user_id", "session_id", "m", F.col("message.role").alias("source"), F.timestamp_millis("message.timestamp").alias("event_at"), F.posexplode(T.chunks(F.col("message.content"))).alias("chunk", "content"))
    place = F.row_number().over(W.partitionBy("user_id", "session_id").orderBy("request_id", "m", "chunk")) - 1
    rows = rows.withColumn("position", place.cast("long"))
    if known is not None:
        last = known.groupBy("user_id", "session_id").agg((F.max("position") + 1).alias("next"))
        rows = rows.join(last, ["user_id", "session_id"], "left").withColumn("position", F.col("position") + F.coalesce("next", F.lit(0))).drop("next")
    c = F.col("content")
    return rows.select("request_id", "user_id", "session_id", "position", "source", "event_at", "content", T.tokens(c).alias("tokens"), T.injection(c).isNotNull().alias("security_sensitive"), F.when(T.is_rule(c), "rule").otherwise("dialogue").alias("material_type"))


def add(spark: SparkSession, requests: DataFrame, store: str) -> None:
    """Append requests to a store of turns, partitioned by user; replayed requests add nothing."""
    try:
        known = spark.read.parquet(store)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = None
    turns_of(requests, known).write.mode("append").partitionBy("user_id").parquet(store)


def stream(lines: DataFrame, store: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """A stream of JSON lines into the store; a batch that is run again after a failure adds nothing twice."""

    def batch(df: DataFrame, _: int) -> None:
        good, bad = parsed(df)
        add(df.sparkSession, good, store)
        bad.write.mode("append").parquet(rejected)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_totals(turns: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Streaming counts per user and hour of event time, with a watermark for late turns."""
    return turns.withWatermark("event_at", delay).groupBy("user_id", F.window("event_at", "1 hour")).agg(F.count("*").alias("n"))

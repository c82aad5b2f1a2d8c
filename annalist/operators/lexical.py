"""Lexical retrieval: postings, corpus statistics, BM25 over a candidate set, stable ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions import vocab as V
from annalist.functions.text import tokens
from annalist.sources.store import stored


def tokenized(rows: DataFrame, content: str = "content") -> DataFrame:
    return rows.withColumn("tokens", tokens(F.col(content)))


def bm25(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, relevance) of every row (id, content; or id, tokens, dl) that shares a token with a query (qid, query).

    Document frequency, count and mean length are those of ``rows``; rows without tokens count.  Postings are cut to the
    queries' terms before anything is shuffled; the statistics are one row.
    """
    docs = rows.select("id", "tokens", "dl") if {"tokens", "dl"} <= set(rows.columns) else tokenized(rows.select("id", "content")).select("id", "tokens", F.size("tokens").alias("dl"))
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).withColumn("avgdl", F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0))
    wanted = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    hits = docs.select("id", "dl", F.explode("tokens").alias("term")).join(wanted.select("term").distinct(), "term")
    tf = hits.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    norm = V.K1 * (1 - V.B + V.B * F.col("dl") / F.col("avgdl"))
    part = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (V.K1 + 1) / (F.col("tf") + norm)
    weighed = tf.join(df, "term").join(F.broadcast(stats)).select("term", "id", part.alias("part"))  # statistics: one row
    return weighed.join(wanted, "term").groupBy("qid", "id").agg(F.round(F.sum("part"), 4).alias("relevance"))


def query_frame(rows: DataFrame, query: str) -> DataFrame:
    return rows.sparkSession.createDataFrame([(0, query)], "qid long, query string")


def ranked(rows: DataFrame, query: str) -> DataFrame:
    """All rows with ``relevance`` (0 without a hit)."""
    scores = bm25(rows, query_frame(rows, query)).select("id", "relevance")
    return rows.join(scores, "id", "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))


def top(scores: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows by an order, numbered from 1: a distributed top-k, then ranks over k rows."""
    cut = scores.orderBy(*order).limit(k)
    return cut.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """All rows with their rank in an order: sorted over the cluster, numbered within each range after those before it."""
    ranged = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "numbered")  # ranges are drawn once
    own = W.partitionBy("part").orderBy(*order)
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    return ranged.withColumn("rank", F.row_number().over(own)).join(F.broadcast(before), "part").withColumn("rank", (F.col("rank") + F.col("before")).cast("int")).drop("part", "before")  # a row for each partition


def top_each(scores: DataFrame, key: str, k: int, *order) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)

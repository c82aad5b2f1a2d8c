"""An inverted index on disk: postings by term, maxima of blocks of documents, exact top k by BM25 without reading the corpus.

An index is a folder of generations; adding documents writes one more.  Postings lie in folders by bucket of the term, so that a
search reads the buckets of its terms only.  A term's best score in a block of documents is bounded by the block's largest
frequency and shortest document, whatever the corpus statistics become later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.functions import vocab as V
from annalist.operators.lexical import top_each
from annalist.sources.store import deleted, exists, shared_path

#: Folders of terms, documents in a block, blocks that are scored to find what a result must reach.
BUCKETS, BLOCK, PROBED = 32, 256, 4


def cached_tokens(content: Column, cache: Column) -> Column:
    """A row's tokens from its cache (JSON text), if that is a list of strings; else, and where CJK letters, Latin ones and CJK
    letters stand side by side (older caches joined those), from the content."""
    variant = F.try_parse_json(cache)
    kind, listed = F.schema_of_variant(variant), F.from_json(cache, "array<string>")
    good = F.coalesce((kind == "ARRAY<STRING>") | ((kind == "ARRAY<VOID>") & (F.size(listed) == 0)), F.lit(False))
    joined = content.rlike("[\\u4e00-\\u9fff][A-Za-z0-9_]+[\\u4e00-\\u9fff]")
    return F.when(good & ~joined, listed).otherwise(T.tokens(content))


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def add(rows: DataFrame, path: str, generation: str) -> None:
    """Write documents (id, content, and content_tokens if there is one) as a generation of the index; one that is there already
    is replaced.  Null contents have no tokens but count as documents."""
    content = F.coalesce("content", F.lit(""))
    words = cached_tokens(content, F.col("content_tokens")) if "content_tokens" in rows.columns else T.tokens(content)
    # dealt out before the texts are cut up and kept until the end: ranges are drawn from ids alone, each text is cut up once
    ranged = rows.repartitionByRange("id").sortWithinPartitions("id").select("id", words.alias("tokens"))
    kept_at = shared_path(rows.sparkSession, "words")
    ranged.select("id", F.size("tokens").alias("dl"), "tokens", F.floor(F.monotonically_increasing_id() / BLOCK).alias("block")).write.parquet(kept_at)
    docs = rows.sparkSession.read.parquet(kept_at)
    terms = docs.select("id", "dl", "block", F.explode("tokens").alias("term")).groupBy("term", "id", "dl", "block").agg(F.count("*").cast("int").alias("tf"))
    spark, at = rows.sparkSession, f"generation={generation}"
    docs.select("id", "dl").write.mode("overwrite").parquet(f"{path}/docs/{at}")
    sized = terms.withColumn("bucket", bucket(F.col("term")))
    sized.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/{at}")
    kept = spark.read.parquet(f"{path}/postings/{at}")
    maxima = kept.groupBy("bucket", "term", "block").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"), F.count("*").alias("n"))
    maxima.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/maxima/{at}")
    totals = spark.read.parquet(f"{path}/docs/{at}").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"))
    totals.write.mode("overwrite").parquet(f"{path}/totals/{at}")  # written last: what has it is complete
    deleted(spark, kept_at)


def complete(spark: SparkSession, path: str, generation: str) -> bool:
    return exists(spark, f"{path}/totals/generation={generation}/_SUCCESS")


def weight(tf: Column, dl: Column) -> Column:
    return tf * (V.K1 + 1) / (tf + V.K1 * (1 - V.B + V.B * dl / F.col("avgdl")))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """The k best documents of each of ``queries`` (qid, query): qid, rank, id, relevance; ties to the smaller id.

    First the bounds of all blocks, from the maxima; then the scores in the blocks that promise most, which tell what the k-th
    result reaches at least; then the scores in all blocks whose bound reaches that.  So the result is exact.
    """
    read = lambda name: spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    asked = queries.select("qid", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term")).withColumn("bucket", bucket(F.col("term")))
    wanted = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # 32 at most
    corpus = read("totals").agg(F.sum("n").alias("n_docs"), F.sum("dl").alias("dl")).select("n_docs", F.when(F.col("dl") > 0, F.col("dl") / F.col("n_docs")).otherwise(1.0).alias("avgdl"))
    terms = asked.select("bucket", "term").distinct()
    maxima = read("maxima").where(F.col("bucket").isin(wanted)).join(terms, ["bucket", "term"], "left_semi")
    df = maxima.groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    idf = df.join(F.broadcast(corpus)).select("bucket", "term", "avgdl", F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # one row
    weighed = asked.join(idf, ["bucket", "term"])
    key = ["bucket", "term"]
    bounds = maxima.join(weighed, key).groupBy("qid", "generation", "block").agg(F.sum(F.col("idf") * weight(F.col("tf"), F.col("dl"))).alias("bound"))
    first = top_each(bounds, "qid", PROBED, F.desc("bound"), "generation", "block").select("qid", "generation", "block")
    postings = read("postings").where(F.col("bucket").isin(wanted)).select("generation", "bucket", "term", "block", "id", "tf", "dl")

    def scored(blocks: DataFrame) -> DataFrame:
        hits = postings.join(weighed, key).join(blocks, ["qid", "generation", "block"])
        return hits.groupBy("qid", "id").agg(F.round(F.sum(F.col("idf") * weight(F.col("tf"), F.col("dl"))), 4).alias("relevance"))

    reached = top_each(scored(first), "qid", k, F.desc("relevance"), "id").where(F.col("rank") == k).select("qid", F.col("relevance").alias("least"))
    open_blocks = bounds.join(reached, "qid", "left").where(F.col("least").isNull() | (F.col("bound") + 1e-3 >= F.col("least"))).select("qid", "generation", "block")
    return top_each(scored(open_blocks), "qid", k, F.desc("relevance"), "id").select("qid", "rank", "id", "relevance")

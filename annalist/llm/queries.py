"""The registered queries of the operators: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import audit, lines, topk, toxicity, trees
from annalist.llm.common import stored
from annalist.llm.decontam import overlaps
from annalist.llm.html import extract
from annalist.llm.huffman import token_ids
from annalist.llm.jaccard import near_duplicates
from annalist.llm.packing import pack
from annalist.llm.prefixes import prefix_counts
from annalist.llm.repair import repair_digest
from annalist.llm.repeats import remove_repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), depth=200)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stored(prefix_counts(table(spark, sf_dir, "documents"), limit=2048), "prefix-counts")
    return counts.select("doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within_limit")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digest(table(spark, sf_dir, "conversations"))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = trees.encode(table(spark, sf_dir, "documents"))
    spelled = F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256)
    texts = trees.decode(ids.withColumn("ids_sha256", spelled))
    return texts.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_ids": op2_token_ids,
    "op3_html": op3_html,
    "op4_repeats": op4_repeats,
    "op5_jaccard": op5_jaccard,
    "op6_topk": op6_topk,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_lines": op9_lines,
    "op10_decontamination": op10_decontamination,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {"op6_topk": topk.ORACLE, "op9_lines": lines.ORACLE, "op13_filter_audit": audit.ORACLE}

"""The corpus pipeline: documents through five operators, each stage on all that the one before it kept.

Every function takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.  All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import toxicity
from annalist.llm.common import cleared, marked, stored
from annalist.llm.decontam import decontaminated
from annalist.llm.jaccard import one_of_each
from annalist.llm.lines import count_names, dedup_lines
from annalist.llm.packing import pack


#: Marks around the tables that line dedup has left in the shared folder; its result reads them until it is written.
_left: list[tuple[int, int]] = []


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones, doesn't reject."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate lines; documents that had nothing else go.  n_chars, if docs have it, follows."""
    removed, begun = F.col(count_names(docs)[1]), marked()
    out = dedup_lines(docs)
    _left.append((begun, marked()))
    out = out.where(~((removed > 0) & (F.length(F.trim("text")) == 0)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(removed > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8: that of the smallest id.

    What line dedup left in the shared folder goes first, unless docs still read it."""
    while _left:
        cleared(spark, docs, *_left.pop())
    return one_of_each(docs, size=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences, a row per piece."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_tokens),
]

#: SQL expresses neither the model, nor the signatures, nor the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one leaves in the shared folder is deleted once the next one's documents are written."""
    docs, begun = spark.read.parquet(f"{sf_dir}/documents.parquet"), marked()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        cleared(spark, docs, begun)
    return STAGES[-1][1](spark, docs, sf_dir)

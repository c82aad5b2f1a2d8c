"""Vector similarity and fusion of rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions import vocab as V


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, rounded to 6 places; vectors of different lengths or with non-finite numbers raise."""
    bad = (F.size(a) != F.size(b)) | F.exists(a, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    value = F.round(dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), 6)
    return F.when(bad, F.raise_error(F.lit("vectors must be finite and of one length")).cast("double")).otherwise(value)


def similarities(vectors: DataFrame, query_id: int) -> DataFrame:
    """(id, similarity) of all vectors (id, embedding) to the one with query_id (one row, which goes to all)."""
    one = vectors.where(F.col("id") == query_id).limit(1).select(F.col("embedding").alias("q"))
    return vectors.crossJoin(F.broadcast(one)).select("id", cosine(F.col("embedding"), F.col("q")).alias("similarity"))


#: Vectors of a block of queries or rows.
BLOCK = 1024


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, same, similarity): of each query (id, embedding, label) its k most similar other rows, ties to the smaller id, at
    least: k of each block.  ``same``: 1 where the labels, numbers, are equal, null where one is null.  A null vector has no
    similarity and comes last.

    All pairs, as products of matrices: a block of queries by a block of rows, as the Cartesian product deals them out.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))  # a row is a block
    cols = [F.col("id").cast("long").alias("id"), F.col("label").cast("double").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")]
    packed = lambda df, name: df.where("id is not null").select(cols).mapInArrow(_blocks, f"{name}_id binary, {name}_label binary, {name} binary").toDF(f"{name}_id", f"{name}_label", name)
    tasks = spark.sparkContext.defaultParallelism
    pairs = packed(rows, "d").repartition(tasks).join(packed(queries, "q").hint("shuffle_replicate_nl"))
    return pairs.select("q_id", "q_label", "q", "d_id", "d_label", "d").mapInArrow(lambda b: _closest(b, k), "qid long, id long, same int, similarity double")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            vectors = part.column(2).to_pylist()
            sizes = {len(v) for v in vectors if v is not None}
            if len(sizes) > 1 or any(v is not None and None in v for v in vectors):
                raise ValueError("vectors must be finite and of one length")
            empty = [np.nan] * max(sizes, default=0)
            data = np.array([empty if v is None else v for v in vectors], np.float64).reshape(len(vectors), -1)
            given = np.array([v is not None for v in vectors])
            norm = np.sqrt((data * data).sum(axis=1))
            if not np.isfinite(data[given]).all() or (norm[given] == 0).any():
                raise ValueError("vectors must be finite, of one length, and not zero")
            label = part.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (part.column(0).to_numpy(), label, data / norm[:, None])], names=["a", "b", "c"])


def _closest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            (qid, qlabel), (id_, label) = ((np.frombuffer(row[i], np.int64), np.frombuffer(row[i + 1])) for i in (0, 3))
            q, d = np.frombuffer(row[2]).reshape(len(qid), -1), np.frombuffer(row[5]).reshape(len(id_), -1)
            if q.shape[1] and d.shape[1] and q.shape[1] != d.shape[1]:
                raise ValueError("vectors must be of one length")
            value = np.round(q @ d.T, 6) if q.shape[1] == d.shape[1] else np.full((len(qid), len(id_)), np.nan)
            value = np.where(np.isnan(value), -np.inf, value)
            parts = []
            for i in range(len(qid)):
                others = np.flatnonzero(id_ != qid[i])
                best = value[i, others]
                if len(others) > k:
                    best = np.flatnonzero(best >= np.partition(best, len(best) - k)[len(best) - k])
                    others = others[best]
                others = others[np.lexsort((id_[others], -value[i, others]))[:k]]
                known = ~(np.isnan(label[others]) | np.isnan(qlabel[i]))
                found = value[i, others]
                parts.append((np.full(len(others), qid[i]), id_[others], label[others] == qlabel[i], found, known))
            asker, other, same, found, known = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.record_batch([pa.array(asker), pa.array(other), pa.array(same.astype(np.int32), mask=~known), pa.array(found, mask=np.isinf(found))], names=["qid", "id", "same", "similarity"])


def fused(candidates: DataFrame, k: int = V.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ``relevance`` and ``similarity`` over a bounded candidate set; ties by lexical rank.

    Rows without a similarity keep no fused score and come after the others.
    """
    lexical = W.orderBy(F.desc("relevance"), "id")
    ranks = candidates.withColumn("lexical_rank", F.row_number().over(lexical))
    semantic = W.orderBy(F.desc_nulls_last("similarity"), "lexical_rank")
    ranks = ranks.withColumn("semantic_rank", F.when(F.col("similarity").isNotNull(), F.row_number().over(semantic)))
    return ranks.withColumn("search_score", F.round(1.0 / (k + F.col("lexical_rank")) + 1.0 / (k + F.col("semantic_rank")), 8))

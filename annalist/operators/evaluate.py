"""Budgeted selection and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def budgeted(ranked: DataFrame, items: int, bytes_: int) -> DataFrame:
    """Of ranked rows (qid, id, rank, bytes), whole items in rank order that still fit: one too large is skipped, not the end.

    Items that go in are at most the first ``items`` of their size: where a later one of that size fits, the earlier ones did.
    So the fold over each query's ranked items has no more than ``items`` of each size up to ``bytes_``, however long the
    ranking.
    """
    first = F.row_number().over(W.partitionBy("qid", "bytes").orderBy("rank", "id"))
    ranked = ranked.where(F.col("bytes") <= bytes_).withColumn("nth", first).where(F.col("nth") <= items)
    row = F.struct("rank", "id", "bytes")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("got"))

    def step(acc, x):
        fits = (acc["used"] + x["bytes"] <= bytes_) & (F.size(acc["got"]) < items)
        return F.struct(F.when(fits, acc["used"] + x["bytes"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["got"], F.array(x["id"].cast("long")))).otherwise(acc["got"]).alias("got"))

    picked = ranked.groupBy("qid").agg(F.aggregate(F.array_sort(F.collect_list(row)), start, step).alias("s"))
    return picked.select("qid", F.posexplode("s.got").alias("p", "id")).select("qid", (F.col("p") + 1).alias("rank"), "id")


def metrics(queries: DataFrame, selected: DataFrame, gold: DataFrame) -> DataFrame:
    """Queries (qid, ...) with gold evidence: n_gold, recall, hit (0 or 1), mrr (0 without a hit)."""
    hits = gold.join(selected.select("qid", "id", "rank"), ["qid", "id"], "left")
    sums = hits.groupBy("qid").agg(F.count("*").alias("n_gold"), F.count("rank").alias("found"), F.min("rank").alias("best"))
    return queries.join(sums, "qid").withColumns({"recall": F.col("found") / F.col("n_gold"), "hit": (F.col("found") > 0).cast("int"), "mrr": F.coalesce(1.0 / F.col("best"), F.lit(0.0))}).drop("found", "best")


def ceilings(gold: DataFrame, items: int, bytes_: int) -> DataFrame:
    """What a perfect selector could find of gold evidence (qid, id, bytes): n_gold, too_many, too_large (more than the budget of
    items, of bytes), ceiling (the share that fits: the smallest ones, as long as they do)."""
    order = W.partitionBy("qid").orderBy("bytes", "id")
    rows = gold.withColumns({"nth": F.row_number().over(order), "used": F.sum("bytes").over(order.rowsBetween(W.unboundedPreceding, 0))})
    fits = (F.col("nth") <= items) & (F.col("used") <= bytes_)
    out = rows.groupBy("qid").agg(F.count("*").alias("n_gold"), F.sum("bytes").alias("bytes"), F.count_if(fits).alias("fit"))
    return out.select("qid", "n_gold", (F.col("n_gold") > items).alias("too_many"), (F.col("bytes") > bytes_).alias("too_large"), (F.col("fit") / F.col("n_gold")).alias("ceiling"))


def without_overlap(pairs: DataFrame, asked: DataFrame, said: DataFrame) -> DataFrame:
    """Those pairs (qid, id) whose question (qid, tokens) and document (id, tokens) share no token."""
    q = asked.select("qid", F.explode(F.array_distinct("tokens")).alias("term"))
    d = said.select("id", F.explode(F.array_distinct("tokens")).alias("term"))
    sharing = pairs.select("qid", "id").join(q, "qid").join(d, ["id", "term"]).select("qid", "id").distinct()
    return pairs.join(sharing, ["qid", "id"], "left_anti")


def nearest(missed: DataFrame, selected: DataFrame) -> DataFrame:
    """Missed evidence (qid, id, session_id, position) with ``distance``: places to the nearest selected turn (qid, session_id,
    position) of its session; null if its session has none.  Both sides go through one sort: the last selected place before and the
    first after."""
    both = missed.withColumn("chosen", F.lit(None).cast("long")).unionByName(selected.select("qid", "session_id", "position", F.col("position").cast("long").alias("chosen")), allowMissingColumns=True)
    order = W.partitionBy("qid", "session_id").orderBy("position")
    before = F.last("chosen", ignorenulls=True).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    after = F.first("chosen", ignorenulls=True).over(order.rangeBetween(W.currentRow, W.unboundedFollowing))
    rows = both.withColumns({"before": F.col("position") - before, "after": after - F.col("position")}).where("id is not null")
    return rows.withColumn("distance", F.least("before", "after")).select(*missed.columns, "distance")

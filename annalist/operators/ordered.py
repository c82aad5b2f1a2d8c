"""Running values and successors along an order, for keys that may hold most of the rows: in blocks of the order.

A window over a key alone is one task for each key.  Here windows run over blocks of a key, and a window over the blocks (a row
each) carries what is known from one to the next; the join that brings it back has the blocks' own partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _with(rows: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """rows with what is known of their blocks; null keys and places are keys and places like others."""
    other = blocks.withColumnsRenamed({key: "_key", "_block": "_at"})
    return rows.join(other, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_at"))).drop("_key", "_at")


def running_max(rows: DataFrame, key: str, order: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """rows with ``name``: the greatest ``value`` of the key so far, by ``order`` (a number; equal ones count together)."""
    rows = rows.withColumn("_block", F.floor(F.col(order) / width))
    inside = W.partitionBy(key, "_block").orderBy(order)
    blocks = rows.groupBy(key, "_block").agg(F.max(value).alias("_top"))
    before = F.max("_top").over(W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.withColumn("_before", before).drop("_top")
    out = _with(rows.withColumn("_own", F.max(value).over(inside)), blocks, key)
    return out.withColumn(name, F.greatest("_own", "_before")).drop("_block", "_own", "_before")


def following(rows: DataFrame, key: str, order: list[str], fields: dict[str, str], width: int) -> DataFrame:
    """rows with fields (new name: column) of the next row of the key by ``order``, whose first column is a number; null at the end.
    Blocks are ``width`` of that number."""
    rows = rows.withColumn("_block", F.floor(F.col(order[0]) / width))
    row = F.struct(*order, *(c for c in dict.fromkeys(fields.values()) if c not in order))
    inside = W.partitionBy(key, "_block").orderBy(*order)
    blocks = rows.groupBy(key, "_block").agg(F.min(row).alias("_first"))
    blocks = blocks.withColumn("_far", F.lead("_first").over(W.partitionBy(key).orderBy("_block"))).drop("_first")
    out = _with(rows.withColumn("_near", F.lead(row).over(inside)), blocks, key)
    near = F.coalesce("_near", "_far")
    return out.withColumns({name: near[c] for name, c in fields.items()}).drop("_block", "_near", "_far")

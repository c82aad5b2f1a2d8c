"""Connected components of an edge table, without moving it to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import dropped, lean, stored

#: Edges that one task unites; more are united by joins.
AT_ONCE = 2_000_000


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of all edges (u, v) of a task: labels fall to the least neighbour's, and then to their labels' labels."""
    columns = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not columns:
        return
    ends = np.concatenate([np.concatenate([u for u, _ in columns]), np.concatenate([v for _, v in columns])])
    ids, at = np.unique(ends, return_inverse=True)
    x, y = at[: len(at) // 2], at[len(at) // 2 :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[x], label[y])
        if (label[x] == label[y]).all():
            break
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while (label[label] != label).any():
            label = label[label]
    yield pa.record_batch([pa.array(ids), pa.array(ids[label])], names=["id", "component"])


def components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """``edges`` (a long, b long) to (id, component): the smallest id reachable, for every id that an edge names.

    At most ``at_once`` different edges are united by one task.  Otherwise large-star and small-star steps (Kiveris et al.
    2014) alternate until no edge changes; each step's edges are written to the shared folder.  Nulls, loops and repeated
    edges don't matter; without edges the result is empty.
    """
    now = stored(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.count() <= at_once:
        out = stored(now.coalesce(1).mapInArrow(lean(united), "id long, component long"), "components")
        dropped(now)
        return out
    before = None
    while True:
        # both directions; every id also has itself, so that a minimum over neighbours covers the id
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that the joins deal their own rows and an id with very many edges can be split
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = stored(small, "edges")
        sums = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(now, least, large, low)
        now = new
        if sums == before:
            break
        before = sums
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)

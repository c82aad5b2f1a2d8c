"""Priority cascade, neighbour bands, links and one-hop expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cascade(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (id, section, moment, relevance) with their rank in the section: all anchors (oldest first), canon entries while the
    limit lasts, ordinary rows by relevance (newest first) for the rest."""
    order = W.partitionBy("section").orderBy(F.desc(F.when(F.col("section") == "ordinary", F.col("relevance")).otherwise(0.0)), F.when(F.col("section") == "ordinary", -F.col("moment")).otherwise(F.col("moment")), "id")
    # only the first ``limit`` ordinary rows can be shown: cut before ranking, so that no task ranks the whole archive
    short = rows.where("section = 'ordinary'").orderBy(F.desc("relevance"), F.desc("moment"), "id").limit(limit)
    rest = rows.where("section <> 'ordinary'")
    n = rest.agg(F.count_if(F.col("section") == "anchor").alias("a"), F.count_if(F.col("section") == "canon").alias("c"))
    room = F.greatest(F.lit(limit) - F.col("a"), F.lit(0))
    ranks = rest.unionByName(short).withColumn("rank", F.row_number().over(order)).join(F.broadcast(n))
    return ranks.where((F.col("section") == "anchor") | ((F.col("section") == "canon") & (F.col("rank") <= room)) | ((F.col("section") == "ordinary") & (F.col("rank") <= room - F.least("c", room))))


def band(seeds: DataFrame, turns: DataFrame, radius: int) -> DataFrame:
    """(seed_id, id, offset) of turns within ``radius`` positions of a seed in its session: an equi-join on exploded offsets."""
    reach = seeds.select(F.col("id").alias("seed_id"), "session_id", F.col("position").alias("p"), F.explode(F.array(*(F.lit(k) for k in range(-radius, radius + 1) if k))).alias("offset")).withColumn("position", F.col("p") + F.col("offset"))
    return reach.join(turns, ["session_id", "position"]).select("seed_id", "id", "offset")


def links_both(links: DataFrame) -> DataFrame:
    """Each link (from_id, to_id, relation) in both directions."""
    back = links.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "relation")
    return links.select("from_id", "to_id", "relation").unionByName(back).distinct()


def expand(ranked: DataFrame, links: DataFrame, budget: int) -> DataFrame:
    """Exact one-hop expansion of ranked rows (qid, id, rank, session_id, position), per query.

    The first three fifths of the budget are seeds.  Seeds take turns; each adds its next neighbour that isn't in yet, links
    before session neighbours, better ranks first.  What is left of the budget is filled by rank.  A query's candidates are
    few (the caller's cap), and a sequential choice with a shared set is not a relational step: it runs per query in pandas.
    """
    import pandas as pd

    seeds = ranked.where(F.col("rank") <= (3 * budget + 4) // 5)
    pairs = links_both(links).join(seeds.select("qid", F.col("id").alias("from_id"), F.col("rank").alias("seed_rank")), "from_id").join(ranked.select("qid", F.col("id").alias("to_id"), F.col("rank").alias("to_rank")), ["qid", "to_id"]).select("qid", "seed_rank", F.lit(0).alias("kind"), "to_rank", F.col("to_id").alias("id"))
    near = seeds.select("qid", F.col("rank").alias("seed_rank"), "session_id", F.explode(F.array(F.col("position") - 1, F.col("position") + 1)).alias("position")).join(ranked.select("qid", "session_id", "position", "id", F.col("rank").alias("to_rank")), ["qid", "session_id", "position"]).select("qid", "seed_rank", F.lit(1).alias("kind"), "to_rank", "id")
    own = ranked.select("qid", F.lit(None).cast("int").alias("seed_rank"), F.lit(2).alias("kind"), F.col("rank").alias("to_rank"), "id")

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        qid = part["qid"].iloc[0]
        base = part[part.kind == 2].sort_values("to_rank")
        seeds_ = base.head((3 * budget + 4) // 5)
        out, seen = [(i, "seed") for i in seeds_.id], set(seeds_.id)
        queues = {r: part[(part.kind < 2) & (part.seed_rank == r)].sort_values(["kind", "to_rank", "id"])[["id", "kind"]].values.tolist() for r in seeds_.to_rank}
        moved = True
        while moved and len(out) < budget:
            moved = False
            for r in seeds_.to_rank:
                queue = queues[r]
                while queue and queue[0][0] in seen:
                    queue.pop(0)
                if queue and len(out) < budget:
                    i, kind = queue.pop(0)
                    seen.add(i)
                    out.append((i, "link" if kind == 0 else "session"))
                    moved = True
        for i in base.id:
            if len(out) >= budget:
                break
            if i not in seen:
                out.append((i, "rank"))
                seen.add(i)
        return pd.DataFrame([(qid, k + 1, int(i), how) for k, (i, how) in enumerate(out)], columns=["qid", "place", "id", "via"])

    return pairs.unionByName(near).unionByName(own).groupBy("qid").applyInPandas(choose, "qid long, place int, id long, via string")

"""Exact top-k by inner product with no random access (Fagin, Lotem and Naor 2003), over blocks of candidates and queries.

Every component has a list of a block's candidates sorted by its value.  The lists are read from both ends, level by level,
for all queries of a block at once: a query takes the upper end where its own component is positive, the lower end where it
is negative.  What has been read gives each candidate a lower and an upper bound of its score.  Reading stops once few
enough candidates, in or outside of what was read, can still reach a query's k-th best lower bound; these get their final
scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import lean, partitions, prepare, stored

#: Vectors in a block of candidates and queries in a block of queries.
CANDIDATES = 2048
QUERIES = 512
#: Blocks of candidates and of queries that meet in one task, about.
TILE, QUERY_TILE = 8, 2
#: Shares of a list read from an end before bounds are compared; after the last, bounds are the scores.
DEPTHS = (0.5, 0.75, 0.875, 0.9375, 1.0)
#: Final scores are resolved once this share of a block's candidates is left.
FEW = 0.12


class Lists:
    """The sorted lists of a block: order[:, d] are candidates by ascending component d, value[:, d] its values."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.value = np.take_along_axis(vectors, self.order, 0)

    def read(self, depth: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the upper and the lower end, after reading ``depth`` of each list from it: what a component is at most (at
        least for the lower end), and at least (at most)."""
        n, dims = self.vectors.shape
        k = min(n, int(np.ceil(n * depth)))
        column = np.arange(dims)
        high_bound = np.broadcast_to(self.value[n - k], (n, dims)).copy()  # unread: no more than the last value read
        high_least = np.broadcast_to(self.value[0], (n, dims)).copy()
        low_bound = np.broadcast_to(self.value[k - 1], (n, dims)).copy()
        low_most = np.broadcast_to(self.value[-1], (n, dims)).copy()
        top, bottom = self.order[n - k :], self.order[:k]
        high_bound[top, column] = high_least[top, column] = self.value[n - k :]
        low_bound[bottom, column] = low_most[bottom, column] = self.value[:k]
        return high_bound, high_least, low_bound, low_most


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Search:
    """The best candidates of a block of queries so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.query = vectors.astype(np.float64)
        self.plus, self.minus = np.maximum(self.query, 0).astype(np.float32), np.minimum(self.query, 0).astype(np.float32)
        self.scores = [np.zeros(0, np.int64) for _ in ids]
        self.found = [np.zeros(0, np.int64) for _ in ids]
        self.least = np.full(len(ids), -np.inf)  # a score below it is not among the k best
        self.resolved = 0  # candidates that got final scores

    def block(self, lists: Lists) -> None:
        n = len(lists.ids)
        # sums of float32 products are exact while they stay below 2 ** 24
        exact = float(np.abs(lists.vectors).max(initial=0)) * float(np.abs(self.query).sum(1).max(initial=0)) < 1 << 23
        kind = np.float32 if exact else np.float64
        plus, minus = self.plus.astype(kind), self.minus.astype(kind)
        other = lists.ids != self.ids[:, None]  # a query's own rows are no candidates and must not set its bound
        for depth in DEPTHS:
            high, high_least, low, low_most = (x.astype(kind) for x in lists.read(depth))
            least = self.least
            if n >= self.k:  # the k-th best lower bound of this block's candidates
                lower = np.where(other, plus @ high_least.T + minus @ low_most.T, -np.inf)
                least = np.maximum(least, np.partition(lower, n - self.k, axis=1)[:, n - self.k])
            left = other & (plus @ high.T + minus @ low.T >= least[:, None])
            if left.mean() <= FEW:
                break
        rows, columns = np.nonzero(left)
        if not len(rows):
            return
        self.resolved += len(rows)
        scores = np.empty(len(rows))
        for a in range(0, len(rows), 1 << 16):
            b = slice(a, a + (1 << 16))
            scores[b] = np.einsum("ij,ij->i", self.query[rows[b]], lists.vectors[columns[b]].astype(np.float64))
        keep = scores >= self.least[rows]
        rows, scores, found = rows[keep], scores[keep].astype(np.int64), lists.ids[columns[keep]]
        cut = np.searchsorted(rows, np.arange(len(self.ids) + 1))
        for q in np.flatnonzero(np.diff(cut)):
            own = slice(cut[q], cut[q + 1])
            self.scores[q], self.found[q] = best(np.r_[self.scores[q], scores[own]], np.r_[self.found[q], found[own]], self.k)
            if len(self.scores[q]) == self.k:
                self.least[q] = self.scores[q][-1]


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, candidates_in_block: int = CANDIDATES, queries_in_block: int = QUERIES) -> DataFrame:
    """The k candidates of highest inner product of every query: query_id, rank (from 1), vec_id, score.

    ``vectors`` (vec_id, embedding): components become floor(scale * x), x as double.  Queries are the rows whose vec_id is
    divisible by ``every``; candidates are all rows but the query's own vec_id.  Ties go to the smaller vec_id.  A query
    with fewer candidates has fewer rows.  Rows with a null vec_id, a null vector, or null or non-finite components take no
    part; vectors of another length than a query's are no candidates of it.  Of rows with one vec_id each is a candidate.
    An empty table gives no rows.

    Tiles of about TILE blocks of candidates meet tiles of about QUERY_TILE blocks of queries, in a task each: no task grows
    with the candidates or with the queries.  A task holds one tile's lists at a time.
    """
    spark = vectors.sparkSession
    prepare(spark)
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"), F.size("embedding").alias("dims"))

    def blocks(size: int):
        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, made_, held = TaskContext.get().partitionId(), 0, {}

            def block(dims: int, n: int) -> pa.RecordBatch:
                nonlocal made_
                ids, values = held[dims]
                row = [pa.array([part << 32 | made_]), pa.array([dims]), pa.array([np.array(ids[:n], np.int64).tobytes()], pa.binary()), pa.array([np.concatenate(values[:n]).astype(np.int64).tobytes() if dims else b""], pa.binary())]
                held[dims] = ids[n:], values[n:]
                made_ += 1
                return pa.record_batch(row, names=["block", "dims", "ids", "vectors"])

            for batch in batches:
                for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids, values = held.setdefault(len(v), ([], []))
                    ids.append(i)
                    values.append(np.asarray(v, np.int64))
                    if len(ids) == size:
                        yield block(len(v), size)
            for dims in list(held):
                if held[dims][0]:
                    yield block(dims, len(held[dims][0]))

        return made

    kind = "block long, dims long, ids binary, vectors binary"
    whole = whole.select("vec_id", "v")
    candidates = stored(whole.mapInArrow(lean(blocks(candidates_in_block)), kind), "candidates")
    queries = stored(whole.where(F.col("vec_id") % every == 0).coalesce(max(1, whole.rdd.getNumPartitions() // every)).mapInArrow(lean(blocks(queries_in_block)), kind), "queries")

    def tiles(table: DataFrame, of: str, size: int) -> DataFrame:
        return table.groupBy("dims").agg(F.ceil(F.count("*") / size).cast("long").alias(of))

    # every tile of queries with every tile of candidates: a stated query set against all rows, in blocks
    grid = stored(tiles(candidates, "n", TILE).join(tiles(queries, "m", QUERY_TILE), "dims"), "grid")
    own = lambda count: F.pmod(F.xxhash64("block"), F.col(count))
    other = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    cells = candidates.join(F.broadcast(grid), "dims").select("dims", own("n").alias("tile"), other("m").alias("part"), F.lit(0).alias("kind"), "ids", "vectors")  # a row for each length of vectors
    asked = queries.join(F.broadcast(grid), "dims").select("dims", other("n").alias("tile"), own("m").alias("part"), F.lit(1).alias("kind"), "ids", "vectors")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, now = [], None
        for batch in batches:
            for dims, tile, part, is_query, ids, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (dims, tile, part) != now:
                    lists, now = [], (dims, tile, part)
                ids = np.frombuffer(ids, np.int64)
                values = np.frombuffer(values, np.int64).reshape(len(ids), dims)
                if not is_query:
                    lists.append(Lists(ids, values))
                    continue
                search = Search(ids, values, k)
                for one in lists:
                    search.block(one)
                n = [len(s) for s in search.scores]
                yield pa.record_batch([pa.array(np.repeat(ids, n)), pa.array(np.concatenate(search.found)), pa.array(np.concatenate(search.scores))], names=["query_id", "vec_id", "score"])

    cell = ["dims", "tile", "part"]
    met = cells.unionByName(asked).repartition(partitions(spark), *cell).sortWithinPartitions(*cell, "kind")
    part = met.mapInArrow(lean(searched), "query_id long, vec_id long, score long")
    # k rows of each query and tile at most
    order = F.struct((-F.col("score")).alias("minus"), "vec_id")
    lists = part.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("best"))
    return lists.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.minus")).alias("score"))


#: DuckDB SQL with the same rows.
ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""

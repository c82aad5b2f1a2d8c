"""BM25 over all pairs of queries and rows where only what a byte budget may pick is wanted.

The pairs are scored a block of queries by a block of rows, as Spark's Cartesian product deals them out.  Of a query's rows only
those are kept that a budget may pick: an item goes in only if fewer than ``items`` others of its size or less rank before it,
as each of those would have gone in.  The rows come by size, in parts, a part after the other; so what is kept of a query tells what a
row must score at least, and it goes on with the query from part to part; the last one gives what the budget picks.  Scores are first
of single precision, and those that reach the bound are worked out again.  Rows that say the same are scored as one, of which only the
first ids can be picked, and so are queries.  What is on disk grows with the queries and the rows, not with the pairs, nor with the
queries times the parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import vocab as V
from annalist.functions.text import tokens
from annalist.operators.lexical import top_each
from annalist.sources.store import deleted, shared_path, stored

#: Queries and rows of a block; blocks of rows in a part.
QUERIES, ROWS, BLOCKS = 1024, 4096, 32
#: Ranges of size within the first block of rows, each with a bound of its own.
RANGES = 16
#: Frequent terms of a product of matrices; pairs of the other terms' places that are laid out at once.
MATRIX, PAIRS = 512, 1 << 16
#: A term is frequent where more than one of so many pairs of a query and a row share it.
DENSE = 2000
#: A null id.
NULL = -(1 << 63)
CANDIDATES = "qid long, id long, relevance double, bytes long"


def candidates(rows: DataFrame, queries: DataFrame, sizes: DataFrame | None, items: int, bytes_: int) -> DataFrame:
    """CANDIDATES: those rows (id, tokens, dl) other than the query (qid, query) itself that a budget of items and bytes picks
    going down the whole ranking, with their relevance and their size of ``sizes`` (id, bytes), or of the rows' own ``bytes``.

    Statistics are those of all rows, as in ``lexical.bm25``.
    """
    spark = rows.sparkSession
    asked, texts, own = encoded(rows, queries, sizes is None)
    if not own:
        texts = texts.join(rows.select("id", "bytes") if sizes is None else sizes, "id")
    said = texts.where((F.col("bytes") <= bytes_) & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("bytes").cast("long").alias("bytes"), "norms", F.transform("terms", F.size).alias("lengths"), F.flatten("terms").alias("terms"))
    n, m = rows.count(), queries.count()
    parts, path = -(-max(n, 1) // (ROWS * BLOCKS)), shared_path(spark, "selection")
    said = said.withColumn("same", F.xxhash64("norms", "lengths", "terms")).repartitionByRange(parts, "bytes", "same").sortWithinPartitions("bytes", "same", "id")
    said.mapInArrow(lambda batches: row_blocks(batches, items + 1), "part int, d binary").write.parquet(f"{path}/rows")  # a file is a part
    blocks = spark.read.schema("part int, d binary").parquet(f"{path}/rows")
    there = sorted(r["part"] for r in blocks.select("part").distinct().collect())  # no more than parts
    asked = asked.withColumn("same", F.xxhash64("terms")).repartition(-(-max(m, 1) // (8 * QUERIES)), "same").sortWithinPartitions("same", "qid")
    left = asked.mapInArrow(lambda batches: query_blocks(batches, True), "q binary, best binary").repartition(max(1, min(-(-m // QUERIES), max(spark.sparkContext.defaultParallelism, m // (8 * QUERIES)))))
    for k, part in enumerate(there[:-1]):
        on = left.join(blocks.where(F.col("part") == part).select("d").coalesce(1).hint("shuffle_replicate_nl"))
        on.mapInArrow(lambda batches: went_on(batches, items), left.schema).write.parquet(f"{path}/{k}")
        left = spark.read.schema(left.schema).parquet(f"{path}/{k}")
        if k:
            deleted(spark, f"{path}/{k - 1}")
    last = blocks.where(F.col("part") == (there[-1] if there else 0)).select("d").coalesce(1)
    return left.join(last.hint("shuffle_replicate_nl")).mapInArrow(lambda batches: picked(batches, items, bytes_), CANDIDATES)


def encoded(rows: DataFrame, queries: DataFrame, own: bool) -> tuple[DataFrame, DataFrame, bool]:
    """Queries (qid, terms, weights), rows (id, norms, terms; a norm for each text of an id), and whether rows have their own ``bytes``."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))  # a row is a block
    twice = rows.groupBy("id").count().where("count > 1").limit(1).count() > 0  # rows of one id and length count as one
    own = own and not twice
    docs = rows.select("id", "dl", "tokens", *["bytes"] * own)
    if twice:
        docs = docs.repartition("id").groupBy("id", "dl").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    vocabulary = stored(docs.select(F.explode(F.array_distinct("tokens")).alias("word")).groupBy("word").agg(F.count("*").alias("df")), "vocabulary")
    salt = salted(vocabulary)
    docs = docs.withColumn("terms", F.transform("tokens", lambda t: F.xxhash64(F.lit(salt), t)))
    df = vocabulary.select(F.xxhash64(F.lit(salt), "word").alias("term"), "df")
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).withColumn("avgdl", F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0))
    wanted = queries.where("qid is not null").select(F.col("qid").cast("long").alias("qid"), F.explode(F.array_distinct(tokens(F.col("query")))).alias("word")).select("qid", F.xxhash64(F.lit(salt), "word").alias("term"))
    weight = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (V.K1 + 1)
    asked = wanted.join(df, "term").join(F.broadcast(stats)).groupBy("qid").agg(F.sort_array(F.collect_set(F.struct("term", weight.alias("weight")))).alias("a")).select("qid", F.col("a.term").alias("terms"), F.col("a.weight").alias("weights"))  # statistics: one row
    norm = V.K1 * (1 - V.B + V.B * F.col("dl") / F.col("avgdl"))
    texts = docs.join(F.broadcast(stats))
    if twice:  # of one id: scores are their sum
        texts = texts.groupBy("id").agg(F.collect_list(norm).alias("norms"), F.collect_list("terms").alias("terms"))
    else:
        texts = texts.where("id is not null").select("id", *["bytes"] * own, F.array(norm).alias("norms"), F.array("terms").alias("terms"))
    return asked, texts, own


def foremost(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, relevance): the k rows (id, tokens, dl) of the greatest relevance for each query (qid, query), ties to the smaller id.

    For few queries and many rows: a block of rows with all queries leaves k rows a query, and only these are shuffled.  Null ids count
    as ids.
    """
    named = lambda t, c: t.withColumn(c, F.coalesce(F.col(c).cast("long"), F.lit(NULL)))
    kinds = {"qid": queries.schema["qid"].dataType, "id": rows.schema["id"].dataType}
    rows, queries = named(rows, "id"), named(queries, "qid")
    asked, texts, _ = encoded(rows, queries, False)
    said = texts.select("id", F.lit(0).cast("long").alias("bytes"), "norms", F.transform("terms", F.size).alias("lengths"), F.flatten("terms").alias("terms"))
    blocks = said.mapInArrow(lambda batches: row_blocks(batches), "part int, d binary").select("d")
    of = stored(asked.repartition(max(1, -(-queries.count() // QUERIES))).mapInArrow(query_blocks, "q binary, best binary").select("q"), "asked")
    some = blocks.join(of.coalesce(1).hint("shuffle_replicate_nl")).mapInArrow(lambda batches: led(batches, k), "qid long, id long, relevance double")
    out = top_each(some, "qid", k, F.desc("relevance"), "id")
    return out.select(*(F.nullif(F.col(c), F.lit(NULL)).cast(kinds[c]).alias(c) if c in kinds else c for c in ("qid", "rank", "id", "relevance")))


def salted(words: DataFrame) -> int:
    """A number with which no two words (word) have the same hash."""
    salt = 0
    while words.groupBy(F.xxhash64(F.lit(salt), "word").alias("term")).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        salt += 1
    return salt


def packed(*columns: np.ndarray) -> bytes:
    """Arrays as one value, each with its type and length."""
    return b"".join(np.array([ord(c.dtype.char), len(c)], np.int64).tobytes() + c.tobytes() + b"\0" * (-c.nbytes % 8) for c in columns)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n = np.frombuffer(data, np.int64, 2, at)
        out.append(np.frombuffer(data, np.dtype(chr(kind)), n, at + 16))
        at += 16 + out[-1].nbytes + -out[-1].nbytes % 8
    return out


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the n + 1 offsets of its rows."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], (at - at[0]).astype(np.int64)


def cuts(n: int, width: int) -> Iterator[tuple[int, int]]:
    """Even ranges of n rows, no wider than width."""
    edges = np.linspace(0, n, -(-n // width) + 1).astype(int)
    return zip(edges[:-1], edges[1:], strict=True)


def differing(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of n lists in a row, with their n + 1 offsets: which are unlike the one before."""
    n = np.diff(at)
    out = np.r_[True, n[1:] != n[:-1]][: len(n)]
    row = np.repeat(np.arange(len(n)), n)
    place = np.flatnonzero(~out[row])
    out[row[place[values[place] != values[place - n[row[place]]]]]] = True
    return out


def merged(batches: Iterator[pa.RecordBatch], key: str, width: int, most: int | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of rows, of ``width`` or more but for the last; neighbours with all but their key in common are one row.  With the first
    ``most`` keys of each row and their number."""
    held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
    total = lambda: [f(x) for f, x in zip((pa.concat_batches, np.concatenate, np.concatenate), zip(*held, strict=True), strict=True)]
    for batch in batches:
        keys, n = batch.column(key).to_numpy(), batch.num_rows
        new = np.zeros(n, bool)
        for name in set(batch.schema.names) - {key}:
            column = batch.column(name)
            new |= differing(*(lists(column) if pa.types.is_list(column.type) else (column.to_numpy(), np.arange(n + 1))))
        row = np.cumsum(new) - 1
        keep = np.arange(n) - np.flatnonzero(new)[row] < (most or n)
        held.append((batch.take(pa.array(np.flatnonzero(new))), keys[keep], np.bincount(row[keep])))
        if sum(b.num_rows for b, *_ in held) >= width:
            yield total()
            held.clear()
    if held:
        yield total()


def alone(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of rows, each with its own key."""
    for batch in batches:
        yield batch, batch.column(key).to_numpy(), np.ones(batch.num_rows, np.int64)


def query_blocks(batches: Iterator[pa.RecordBatch], merge: bool = False) -> Iterator[pa.RecordBatch]:
    """Blocks of queries: the ids, the terms of each query and their weights, and how many ids each has."""
    for batch, qid, copies in merged(batches, "qid", 4 * QUERIES, None) if merge else alone(batches, "qid"):
        (term, at), (weight, _), ids = lists(batch.column("terms")), lists(batch.column("weights")), np.r_[0, np.cumsum(copies)]
        for i, j in cuts(len(copies), QUERIES):
            block = packed(qid[ids[i] : ids[j]], at[i : j + 1] - at[i], term[at[i] : at[j]], weight[at[i] : at[j]], copies[i:j])
            yield pa.record_batch([pa.array([block], pa.binary()), pa.array([None], pa.binary())], names=["q", "best"])


def narrow(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the narrowest type that holds them."""
    return values.astype(np.min_scalar_type(values.max(initial=0)))


def row_blocks(batches: Iterator[pa.RecordBatch], most: int = 0) -> Iterator[pa.RecordBatch]:
    """Blocks of rows with the number of their partition: the texts of each row, the texts of each term with the number of its places.
    With ``most``, neighbours that say the same are one row with so many ids."""
    from pyspark import TaskContext

    context = TaskContext.get()
    part = context.partitionId() if context else 0
    for batch, id_, copies in merged(batches, "id", 4 * ROWS, most) if most else alone(batches, "id"):
        size, ids = batch.column("bytes").to_numpy(), np.r_[0, np.cumsum(copies)]
        (norm, texts), (length, _), (terms, _) = (lists(batch.column(c)) for c in ("norms", "lengths", "terms"))
        at = np.r_[0, np.cumsum(length)]
        for i, j in cuts(len(size), ROWS):
            row = np.repeat(np.arange(j - i), np.diff(texts[i : j + 1]))
            begin, end = texts[i], texts[j]
            text, term = np.repeat(np.arange(end - begin), length[begin:end]), terms[at[begin] : at[end]]
            sort = np.lexsort((text, term))
            text, term = text[sort], term[sort]
            head = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (term[1:] != term[:-1])][: len(text)])
            times = np.diff(np.r_[head, len(text)])
            known, count = np.unique(term[head], return_counts=True)
            block = packed(id_[ids[i] : ids[j]], size[i:j].astype(np.int32), row.astype(np.int16), norm[begin:end], known, narrow(count), narrow(text[head]), narrow(times), narrow(copies[i:j]))
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.binary())], names=["part", "d"])


def opened(data: bytes) -> list[np.ndarray]:
    """A block of rows: ids, size of each row; row of each text, its norm; text, term and number of places of each posting; how many ids each
    row has."""
    id_, size, row, norm, known, count, text, times, copies = unpacked(data)
    return [id_, size, row, norm, text, np.repeat(known, count), times.astype(np.int32), copies]


class Postings:
    """A block of rows by term: the terms, where the postings of each begin, and each one's text and value."""

    def __init__(self, rows: list[np.ndarray]):
        _, self.size, self.row, self.norm, text, term, times, *_ = rows
        if (term[1:] < term[:-1]).any():
            by = np.argsort(term, kind="stable")
            text, term, times = text[by], term[by], times[by]
        begin = np.flatnonzero(np.r_[True, term[1:] != term[:-1]][: len(term)])
        self.known, self.at = term[begin], np.r_[begin, len(term)]
        self.text, self.value = text.astype(np.int64), times / (times + self.norm[text])
        self.of = self.row[text].astype(np.int64)


class Terms:
    """A block's queries by term: the terms, how many queries have each and where these begin, and each one's query and weight."""

    def __init__(self, query: list[np.ndarray]):
        at, term, weight = query[1:4]
        self.queries = len(at) - 1
        self.known, of = np.unique(term, return_inverse=True)
        asks = np.argsort(of, kind="stable")
        self.asker, self.weight = np.repeat(np.arange(self.queries), np.diff(at))[asks], weight[asks]
        self.many = np.bincount(of, minlength=len(self.known))
        self.first = np.cumsum(self.many) - self.many


def scores(query: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """Relevance of a block's queries and rows."""
    return product(Terms(query), Postings(rows), np.float64)


def product(asked: Terms, said: Postings, kind: type) -> np.ndarray:
    """Relevance of queries and rows: frequent terms as a product of matrices, the others pair by pair."""
    n, out = len(said.size), np.zeros((asked.queries, len(said.size)), kind)
    _, mine, theirs = np.intersect1d(asked.known, said.known, assume_unique=True, return_indices=True)
    many, count = asked.many[mine], np.diff(said.at)[theirs]
    first, begin = asked.first[mine], said.at[theirs]
    weight, value, frequent = asked.weight.astype(kind), said.value.astype(kind), many * count > out.size // DENSE
    for some in np.split(np.flatnonzero(frequent), range(MATRIX, np.count_nonzero(frequent), MATRIX)):
        ask, post, place = spread(first[some], many[some]), spread(begin[some], count[some]), np.arange(len(some))
        a = np.zeros((asked.queries, len(some)), kind)
        a[asked.asker[ask], np.repeat(place, many[some])] = weight[ask]
        out += a @ np.bincount(np.repeat(place, count[some]) * n + said.of[post], value[post], len(some) * n).reshape(len(some), n).astype(kind)
    post, first, many = spread(begin[~frequent], count[~frequent]), np.repeat(first[~frequent], count[~frequent]), np.repeat(many[~frequent], count[~frequent])
    ends, i = np.cumsum(many), 0
    while i < len(post):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        ask, now = spread(first[i:j], many[i:j]), np.repeat(post[i:j], many[i:j])
        np.add.at(out.ravel(), asked.asker[ask] * n + said.of[now], weight[ask] * value[now])
        i = j
    return out


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ranges of n places from each start, one after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def exact(query: list[np.ndarray], said: Postings, q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Relevance of some pairs of a block's queries and rows."""
    at, term, weight = query[1:4]
    k = np.minimum(np.searchsorted(said.known, term), len(said.known) - 1)
    there = said.known[k] == term
    at = np.r_[0, np.cumsum(there)][at]
    k, weight, width = k[there], weight[there], len(said.row)
    posting = np.repeat(np.arange(len(said.known)), np.diff(said.at)) * width + said.text  # ascending
    texts = np.bincount(said.row, minlength=len(said.size))
    pair, text = np.repeat(np.arange(len(q)), texts[d]), spread((np.cumsum(texts) - texts)[d], texts[d])
    n = np.diff(at)[q[pair]]
    ask, text, pair = spread(at[q[pair]], n), np.repeat(text, n), np.repeat(pair, n)
    wanted = k[ask] * width + text
    found = np.minimum(np.searchsorted(posting, wanted), len(posting) - 1)
    hit = posting[found] == wanted
    return np.bincount(pair[hit], weight[ask[hit]] * said.value[found[hit]], len(q))


class Best:
    """What a budget may pick for the queries of one block: query, id, relevance and bytes, by query and rank.

    Rows with fewer than ``items`` others before them stay, so one more than the budget takes, as a query is no answer to itself."""

    def __init__(self, queries: int, items: int, kept: bytes | None = None):
        self.queries, self.items = queries, items
        self.query, self.id, self.score, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)
        self.more: list[tuple[np.ndarray, ...]] = []  # not yet among them
        if kept is not None:
            n, self.id, score, self.bytes = unpacked(zlib.decompress(kept))
            self.query, self.score = np.repeat(np.arange(len(n)), n), score / 1e4

    def kept(self) -> bytes:
        """All of it as one value; scores have four places."""
        self.settle()
        return zlib.compress(packed(narrow(np.bincount(self.query, minlength=self.queries)), self.id, narrow(np.rint(self.score * 1e4).astype(np.int64)), self.bytes), 1)

    def within(self, size: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and relevance of the pairs of the first block that count: no range of its rows has ``items`` better ones in those before."""
        edges = np.unique(np.linspace(0, len(size), RANGES + 1).astype(int))
        top, found = np.zeros((self.queries, self.items)), []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            q, d = np.nonzero((score[:, i:j] >= top.min(axis=1)[:, None] - 1e-4) & (score[:, i:j] > 0))  # scores are rounded below
            found.append((q, d + i))
            part = np.c_[top, score[:, i:j]]
            top = np.partition(part, part.shape[1] - self.items, axis=1)[:, -self.items :]
        q, d = (np.concatenate(x) for x in zip(*found, strict=True))
        return q, d, score[q, d]

    def bound(self, least: int) -> np.ndarray:
        """For each query a score that ``items`` rows have that are no larger than that."""
        fits = np.flatnonzero(self.bytes <= least)  # in order of rank
        begin = np.searchsorted(self.query[fits], np.arange(self.queries + 1))
        full, out = np.flatnonzero(np.diff(begin) >= self.items), np.zeros(self.queries)
        out[full] = self.score[fits[begin[full] + self.items - 1]]
        return out

    def add(self, query: list[np.ndarray], rows: list[np.ndarray], asked: Terms) -> None:
        """One more block of rows, sorted by size."""
        id_, size, copies, said = rows[0], rows[1], rows[-1], Postings(rows)
        if not len(said.known):
            return
        if not len(self.query):
            self.settle()
        if not len(self.query):
            q, d, score = self.within(size, product(asked, said, np.float64))
        else:
            bound, rough = self.bound(size[0]), product(asked, said, np.float32)
            least = (bound * (1 - 1e-4) - 1e-3).clip(1e-30).astype(np.float32)
            q, d = np.divmod(np.flatnonzero(rough >= least[:, None]), len(size))
            score = exact(query, said, q, d)
            near = score >= bound[q] - 1e-4  # scores are rounded below
            q, d, score = q[near], d[near], score[near]
        n = copies[d].astype(np.int64)
        ends = np.cumsum(copies, dtype=np.int64)
        self.more.append((np.repeat(q, n), id_[spread((ends - copies)[d], n)], np.repeat(np.round(score, 4), n), np.repeat(size[d], n)))
        if sum(len(x[0]) for x in self.more) > 8 * self.queries:
            self.settle()

    def settle(self) -> None:
        """What was found since then goes among the rest."""
        if not self.more:
            return
        query, ids, score, size = (np.concatenate(x) for x in zip((self.query, self.id, self.score, self.bytes), *self.more, strict=True))
        self.more = []
        order = np.lexsort((size, ids, -score, query))
        query, ids, score, size = query[order], ids[order], score[order], size[order]
        keep = undominated(query, size, self.queries, self.items)
        self.query, self.id, self.score, self.bytes = query[keep], ids[keep], score[keep], size[keep]


def undominated(query: np.ndarray, size: np.ndarray, queries: int, items: int) -> np.ndarray:
    """Of rows by query and rank, those with fewer than ``items`` before them that are no larger."""
    n = np.bincount(query, minlength=queries)
    first = np.cumsum(n) - n
    least = np.full((queries, items), np.iinfo(size.dtype).max, size.dtype)  # the smallest sizes so far, sorted
    keep = np.zeros(len(query), bool)
    by = np.argsort(-n, kind="stable")
    for place in range(int(n.max(initial=0))):
        by = by[: np.count_nonzero(n[by] > place)]
        at = first[by] + place
        new = size[at] < least[by, -1]
        keep[at[new]] = True
        rows = by[new]
        least[rows, -1] = size[at[new]]
        least[rows] = np.sort(least[rows], axis=1)
    return keep


def fitting(query: np.ndarray, size: np.ndarray, queries: int, items: int, bytes_: int) -> np.ndarray:
    """Of rows by query and rank, those that go in: one too large is skipped, not the end."""
    n = np.bincount(query, minlength=queries)
    first = np.cumsum(n) - n
    used, got, keep = np.zeros(queries, np.int64), np.zeros(queries, np.int64), np.zeros(len(query), bool)
    by = np.argsort(-n, kind="stable")
    for place in range(int(n.max(initial=0))):
        by = by[: np.count_nonzero(n[by] > place)]
        at = first[by] + place
        fits = (used[by] + size[at] <= bytes_) & (got[by] < items)
        keep[at[fits]] = True
        used[by[fits]] += size[at[fits]]
        got[by[fits]] += 1
    return keep


def followed(batches: Iterator[pa.RecordBatch], items: int) -> Iterator[tuple[bytes, Best]]:
    """Blocks of queries, each with all blocks of rows of a part, and what is then kept of them."""
    now = query = asked = best = None
    for batch in batches:
        for q, kept, d in zip(batch.column("q"), batch.column("best"), batch.column("d"), strict=True):
            q, d = q.as_buffer(), opened(d.as_py())
            if now is None or not q.equals(now):
                if best is not None:
                    yield now, best
                now = pa.py_buffer(q.to_pybytes())
                query = unpacked(now)
                asked, best = Terms(query), Best(len(query[4]), items + 1, kept.as_py())
            best.add(query, d, asked)
    if best is not None:
        yield now, best


def went_on(batches: Iterator[pa.RecordBatch], items: int) -> Iterator[pa.RecordBatch]:
    """Blocks of queries with what is kept of them after one more part."""
    for q, best in followed(batches, items):
        yield pa.record_batch([pa.array([q.to_pybytes()], pa.binary()), pa.array([best.kept()], pa.binary())], names=["q", "best"])


def picked(batches: Iterator[pa.RecordBatch], items: int, bytes_: int) -> Iterator[pa.RecordBatch]:
    """Blocks of queries with the last part to CANDIDATES."""
    for q, best in followed(batches, items):
        best.settle()
        qid, *_, copies = unpacked(q)
        n = np.bincount(best.query, minlength=len(copies))
        of = np.repeat(np.arange(len(copies)), copies)  # each id's query
        asker, at = np.repeat(np.arange(len(qid)), n[of]), spread((np.cumsum(n) - n)[of], n[of])
        other = best.id[at] != qid[asker]
        asker, at = asker[other], at[other]
        keep = fitting(asker, best.bytes[at], len(qid), items, bytes_)
        asker, at = asker[keep], at[keep]
        yield pa.record_batch([pa.array(qid[asker]), pa.array(best.id[at]), pa.array(best.score[at]), pa.array(best.bytes[at].astype(np.int64))], names=["qid", "id", "relevance", "bytes"])


def led(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows with blocks of queries to the first k of each query in each block of rows."""
    for batch in batches:
        for q, d in zip(batch.column("q"), batch.column("d"), strict=True):
            query, rows = unpacked(q.as_py()), opened(d.as_py())
            score = scores(query, rows)
            hit, score = score > 0, np.round(score, 4)
            least = np.partition(score, -k, axis=1)[:, -k:][:, :1] if score.shape[1] > k else 0
            of, at = np.nonzero(hit & (score >= least))
            order = np.lexsort((rows[0][at], -score[of, at], of))
            of, at = of[order], at[order]
            first = np.searchsorted(of, of)
            keep = np.arange(len(of)) - first < k
            of, at = of[keep], at[keep]
            yield pa.record_batch([pa.array(query[0][of]), pa.array(rows[0][at]), pa.array(score[of, at])], names=["qid", "id", "relevance"])

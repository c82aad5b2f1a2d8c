"""Token ids in a compressed binary form: canonical length-limited Huffman codes from global counts.

The format is a folder of two Parquet tables:

``codes``   one row per id that occurs: ``id``, ``bits`` (length of its canonical code, at most ``LIMIT``, or what so many
            ids need).
``blocks``  one row per block of whole documents in ascending doc_id order: ``first`` (ids of all documents before the
            block), ``docs`` (int64 doc ids, 0 for a null one), ``nulls`` (a byte for each, 1 if it is null; empty if none
            is), ``counts`` (int64 ids of each), ``bits`` (the codes, most significant bit first, padded with four zero
            bytes) and ``marks`` (uint32 bit offset of every ``STRIDE``-th id).
A block is decoded on its own, and inside it from every mark on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import dropped, gathered, lean, partitions, prepare, release_shuffles, shared_path, slices, stored, text_bytes, texts_of
from annalist.llm.tokens import END_ID, Encoder, vocabulary_path, with_end

LIMIT = 18
#: A decoding step looks at 32 bits from a whole byte on.
WIDEST = 25
STRIDE = 128
BLOCK = 1 << 17


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.float64)[order]
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        even = len(level) // 2 * 2
        both = np.concatenate([leaves, level[0:even:2] + level[1:even:2]])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        is_leaf.append(rank < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(is_leaf):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes: by length, then id; ``ids`` ascending."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        size = int(ids.max()) + 1 if len(ids) else 1
        self.bits = np.zeros(size, np.uint8)
        self.code = np.zeros(size, np.uint64)
        self.most = int(lengths.max()) if len(lengths) else 1
        order = np.lexsort((ids, lengths))
        ids, lengths = np.asarray(ids)[order], np.asarray(lengths)[order].astype(np.int64)
        # the canonical code of a symbol, left-aligned, is the sum of the shares of those before it
        share = np.left_shift(1, self.most - lengths)
        left = np.cumsum(share) - share
        self.bits[ids] = lengths
        self.code[ids] = left >> (self.most - lengths)
        self.symbol = np.repeat(ids, share).astype(np.uint32)
        self.width = np.repeat(lengths, share).astype(np.uint8)
        if len(self.symbol) < 1 << self.most:
            spare = (1 << self.most) - len(self.symbol)
            self.symbol = np.r_[self.symbol, np.zeros(spare, np.uint32)]
            self.width = np.r_[self.width, np.ones(spare, np.uint8)]

    def encode(self, ids: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
        bits = self.bits[ids].astype(np.int64)
        ends = np.cumsum(bits)
        begins = ends - bits
        total = int(ends[-1]) if len(ends) else 0
        word = begins >> 5
        # each code lies in two 32-bit words at most; codes don't overlap, so a sum over a word's codes joins them
        high_low = self.code[ids] << (64 - (begins & 31) - bits).astype(np.uint64)
        out = np.zeros(total // 32 + 2, np.uint64)
        heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
        if len(heads):
            out[word[heads]] += np.add.reduceat(high_low >> np.uint64(32), heads)
            out[word[heads] + 1] += np.add.reduceat(high_low & np.uint64(0xFFFFFFFF), heads)
        return out.astype(">u4").tobytes()[: (total + 7) // 8] + b"\0\0\0\0", begins[::stride].astype(np.uint32)

    def decode(self, bits: bytes, marks: np.ndarray, total: int, stride: int = STRIDE) -> np.ndarray:
        """All marked stretches at once, one id of each in a step, by table."""
        raw = np.frombuffer(bits, np.uint8)
        b = raw.astype(np.uint32)
        ahead = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
        out = np.zeros((len(marks), stride), np.uint32)
        at, down, last = marks.astype(np.int64), np.uint32(32 - self.most), len(ahead) - 1
        for k in range(stride):
            peek = (ahead[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> down
            out[:, k] = self.symbol[peek]
            at = at + self.width[peek]
        return out.reshape(-1)[:total]


#: A row of a file: the ids before its documents, their doc_ids (and which are null), numbers of ids, code and offsets in it.
BLOCKS = "first long, docs binary, nulls binary, counts binary, bits binary, marks binary"


def write_ids(docs: DataFrame, to: str, path: str | None = None, end_id: int | None = END_ID, size_of_block: int = BLOCK) -> None:
    """Encode every text of ``docs`` (doc_id, text) and write the ids to the folder ``to``.

    A null or empty text has ``end_id`` alone (no ids if it is None).  Repeated doc_ids stay, in any order among
    themselves; null ones come first.  The blocks are in the order of the documents, in
    each file and from file to file (a folder for each range of doc_ids).  An empty table gives an empty folder of blocks.  Texts are dealt out by doc_id ranges
    once and tokenized there; ids are kept in the shared folder until the codes are known.  A block has ``size_of_block`` ids
    at most, or one document.  The driver gets a count for each id of the vocabulary and one length for each partition.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = path or vocabulary_path()

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, at, seen = TaskContext.get().partitionId(), Encoder(path), 0, np.zeros(0, np.int64)
        for batch in gathered(batches):
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets, 8 << 20):
                ids, counts = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if end_id is not None:
                    ids, counts = with_end(ids, counts, end_id)
                found = np.bincount(ids)
                if len(found) > len(seen):
                    seen, found = found, seen
                seen[: len(found)] += found
                narrow = ids.astype(np.uint16) if len(seen) <= 1 << 16 else ids
                width, ends = narrow.itemsize, np.cumsum(counts)
                values = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((np.r_[0, ends] * width).astype(np.int32)), pa.py_buffer(narrow)])
                yield pa.record_batch([pa.array(np.full(b - a, part)), batch.column(0).slice(a, b - a), pa.array(at + ends - counts), pa.array(counts), values, pa.nulls(b - a, pa.binary())], names=names)
                at += int(ends[-1])
        kinds = np.flatnonzero(seen)
        if len(kinds):
            yield pa.record_batch([pa.array([part]), pa.nulls(1, pa.int64()), pa.array([0]), pa.array([at]), pa.nulls(1, pa.binary()), pa.array([np.stack([kinds, seen[kinds]]).tobytes()], pa.binary())], names=names)

    names = ["part", "doc_id", "at", "n", "ids", "seen"]
    texts = texts_of(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    kept = stored(texts.mapInArrow(lean(tokenized), "part long, doc_id long, at long, n long, ids binary, seen binary"), "ids")
    del texts
    release_shuffles(spark)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                kinds, n = np.frombuffer(blob, np.int64).reshape(2, -1)
                if kinds[-1] >= len(total):
                    total = np.r_[total, np.zeros(kinds[-1] + 1 - len(total), np.int64)]
                total[kinds] += n
        kinds = np.flatnonzero(total)
        yield pa.record_batch([pa.array(kinds), pa.array(total[kinds])], names=["id", "n"])

    counts = kept.where("seen is not null").select("seen").coalesce(partitions(spark) // 16 + 1).mapInArrow(lean(counted), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")
    lengths = dict(kept.where("seen is not null").select("part", "n").collect())
    begins, total = {}, 0
    for part in sorted(lengths):
        begins[part] = total
        total += lengths[part]
    ids, bits = counts["id"].to_numpy(np.int64), code_lengths(counts["n"].to_numpy(np.int64), max(LIMIT, (len(counts) - 1).bit_length()))
    if len(bits) and bits.max() > WIDEST:
        raise ValueError(f"{len(bits)} ids need codes of more than {WIDEST} bits")
    spark.createDataFrame(pa.table({"id": ids, "bits": bits.astype(np.int64)}).to_pandas(), "id long, bits long").coalesce(1).write.parquet(f"{to}/codes")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, held, size, now = Codebook(ids, bits), [], 0, 0

        def block() -> pa.RecordBatch:
            code, marks = book.encode(np.concatenate([x[3] for x in held]))
            one = lambda v, kind: pa.array([v], kind)
            missing = [x[1] is None for x in held]
            blobs = [np.array([x[1] or 0 for x in held], np.int64).tobytes(), bytes(missing) if any(missing) else b"", np.array([x[2] for x in held], np.int64).tobytes(), code, marks.tobytes()]
            return pa.record_batch([one(held[0][0], pa.int64()), *(one(b, pa.binary()) for b in blobs), one(f"{now:08d}", pa.string())], names=[c.split()[0] for c in f"{BLOCKS}, range string".split(", ")])

        for batch in batches:
            for part, doc, at, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = begins[part] + at
                if held and (part != now or first != held[-1][0] + held[-1][2] or size + n > size_of_block):
                    yield block()
                    held, size = [], 0
                now = part
                held.append((first, doc, n, np.frombuffer(blob, np.uint16 if len(blob) == 2 * n else np.uint32)))
                size += n
        if held:
            yield block()

    coded = kept.where("seen is null").select("part", "doc_id", "at", "n", "ids").mapInArrow(lean(blocks), f"{BLOCKS}, range string")
    # tables are read in another order than they were written in: a folder for each range of documents, by name in their order
    coded.write.partitionBy("range").parquet(f"{to}/blocks")
    dropped(kept)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder that write_ids() made: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32)."""
    codes = spark.read.parquet(f"{folder}/codes").toPandas().sort_values("id")
    ids, bits = codes["id"].to_numpy(np.int64), codes["bits"].to_numpy(np.int64)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(ids, bits)
        for batch in batches:
            for first, docs, nulls, counts, code, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs, counts = pa.array(np.frombuffer(docs, np.int64), mask=np.frombuffer(nulls, bool) if nulls else None), np.frombuffer(counts, np.int64)
                ends = np.cumsum(counts)
                flat = book.decode(code, np.frombuffer(marks, np.uint32), int(ends[-1]))
                values = pa.BinaryArray.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer((np.r_[0, ends] * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
                yield pa.record_batch([docs, pa.array(first + ends - counts), pa.array(counts), values], names=["doc_id", "start", "n_tokens", "ids"])

    prepare(spark)
    return spark.read.schema(f"{BLOCKS}, range string").parquet(f"{folder}/blocks").drop("range").mapInArrow(lean(decoded), "doc_id long, start long, n_tokens long, ids binary")


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """write_ids() to a new place in the shared folder, and read_ids() of it."""
    to = shared_path(docs.sparkSession, "token-ids")
    write_ids(docs, to, path)
    return read_ids(docs.sparkSession, to)

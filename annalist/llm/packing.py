"""Packing token sequences: bounded-space online packing, best fit over a fixed number of open windows."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import gathered, lean, prepare, slices, stored, text_bytes, texts_of
from annalist.llm.tokens import END_ID, Encoder, vocabulary_path, with_end

WINDOW = 4096
#: Windows that a partition keeps open.
OPEN = 64
#: Sequences that a partition can number; partition p numbers from p * SPAN.
SPAN = 1 << 40

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
LOOSE = PIECE + ", part long, at long, ids binary"


class Packer:
    """Places pieces into open windows; a full window leaves at once.

    A piece goes to the open window that it fills best.  If none has room for it, the fullest window takes as much of
    the piece as fills it and is emitted, and the rest is placed again: with free cuts no emitted window has padding.
    Space is bounded: ``open_windows`` windows of at most ``window`` tokens.
    """

    def __init__(self, part: int, window: int = WINDOW, open_windows: int = OPEN):
        self.window, self.most = window, open_windows
        self.next = part * SPAN
        self.rooms: list[tuple[int, int]] = []  # (room left, sequence), sorted
        self.held: dict[int, list[tuple]] = {}

    def new(self) -> tuple[int, int]:
        seq, self.next = self.next, self.next + 1
        self.held[seq] = []
        return self.window, seq

    def put(self, doc: int, ids: np.ndarray) -> Iterator[tuple]:
        """Rows (doc_id, start, length, crc32, doc_tokens, sequence_id, offset) of the windows that became full."""
        start, n = 0, len(ids)
        while start < n:
            left = n - start
            k = bisect_left(self.rooms, (left, -1))
            if k < len(self.rooms):  # the least room that is enough
                room, seq = self.rooms.pop(k)
            elif len(self.rooms) < self.most or left >= self.window:
                room, seq = self.new()
            else:  # none fits: the fullest is filled and leaves
                room, seq = self.rooms.pop(0)
            length = min(room, left)
            self.held[seq].append((doc, start, length, ids[start : start + length], n, self.window - room))
            start += length
            if room == length:
                for d, s, m, part, total, offset in self.held.pop(seq):
                    yield d, s, m, zlib.crc32(part), total, seq, offset
            else:
                insort(self.rooms, (room - length, seq))

    def rest(self) -> Iterator[tuple]:
        """(doc_id, start, ids, doc_tokens) of what the open windows hold at the end, the fullest window first."""
        for _, seq in self.rooms:
            for d, s, _, part, total, _ in self.held[seq]:
                yield d, s, part, total


def pieces_of(spans: list[tuple], begin: int, window: int, total: int, first_id: int) -> Iterator[tuple]:
    """Cut the concatenation of spans, which starts at token ``begin`` of ``total``, into sequences.

    Sequences hold ``window`` tokens; what is left at the very end is cut into powers of two, which need no padding.
    """
    whole = total // window
    for doc, start, ids, n in spans:
        at = 0
        while at < len(ids):
            g = begin + at
            seq, low, high = first_id + g // window, g // window * window, (g // window + 1) * window
            if g >= whole * window:  # the tail: its binary digits, the largest first
                low, tail, seq = whole * window, total - whole * window, first_id + whole
                for bit in range(tail.bit_length() - 1, -1, -1):
                    if tail >> bit & 1:
                        high = low + (1 << bit)
                        if g < high:
                            break
                        low, seq = high, seq + 1
            length = min(high - g, len(ids) - at)
            yield doc, start + at, length, zlib.crc32(ids[at : at + length]), n, seq, g - low
            at += length
        begin += len(ids)


def _batch(rows: list[tuple], loose: bool) -> pa.RecordBatch:
    names = "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()
    doc, *numbers = zip(*(r[:7] for r in rows), strict=True) if rows else [[]] * 7
    columns = [pa.array(doc, pa.int64()), *(pa.array(np.asarray(c, np.int64)) for c in numbers)]
    if loose:
        columns += [pa.array([r[7] for r in rows], pa.int64()), pa.array([r[8] for r in rows], pa.int64()), pa.array([r[9] for r in rows], pa.binary())]
        names += ["part", "at", "ids"]
    return pa.record_batch(columns, names=names)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, open_windows: int = OPEN, end_id: int = END_ID) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``window`` tokens; one row per piece.

    Each document is its ids and ``end_id``; a null or empty text is ``end_id`` alone.  Repeated rows are packed each; a null
    doc_id stays null.
    An empty table gives no rows.  Documents are cut where a window ends.  ``sequence_id`` is unique but not dense.

    Every partition packs what it reads in one pass.  What its open windows hold at its end (fewer than ``open_windows``
    windows) is merged over all partitions: the driver gets one length per partition, so that every leftover knows its
    place in their concatenation, and leftovers are cut there, each on its own; no task gathers them.  Only the very
    last tokens don't fill a window; they are cut into powers of two.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = path or vocabulary_path()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, packer = Encoder(path), Packer(part, window, open_windows)
        for batch in gathered(batches):
            docs_, (data, offsets) = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for a, b in slices(offsets):  # small: the last stage's workers hold what earlier ones left
                ids, counts = with_end(*encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), end_id)
                ends = np.cumsum(counts)
                rows = [(*r, None, None, None) for d, e, m in zip(docs_[a:b], ends, counts, strict=True) for r in packer.put(d, ids[e - m : e])]
                if rows:
                    yield _batch(rows, True)
        rows, at = [], 0
        for d, s, ids, n in packer.rest():
            rows.append((d, s, len(ids), 0, n, 0, 0, part, at, ids.tobytes()))
            at += len(ids)
        yield _batch(rows, True)

    first = stored(texts_of(docs).mapInArrow(lean(packed), LOOSE), "packing")
    done = first.where("part is null").drop("part", "at", "ids")
    # one row per partition: at most as many as the stage had tasks
    lengths = {r["part"]: r["n"] for r in first.where("part is not null").groupBy("part").agg(F.sum("length").alias("n")).collect()}
    begins, total = {}, 0
    for part in sorted(lengths):
        begins[part] = total
        total += lengths[part]
    first_id = -(total // window + window.bit_length() + 1)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [p for r in batch.to_pylist() for p in pieces_of([(r["doc_id"], r["start"], np.frombuffer(r["ids"], np.uint32), r["doc_tokens"])], begins[r["part"]] + r["at"], window, total, first_id)]
            yield _batch(rows, False)

    return done.unionByName(first.where("part is not null").mapInArrow(lean(merged), PIECE))

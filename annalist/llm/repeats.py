"""Exact removal of repeated byte strings over all documents, by suffix arrays.

1. Every window of ``depth`` bytes has an anchor: the k-mer in it with the least hash, the leftmost of equal ones.  Windows in
   a row with one anchor make a stretch.  Equal windows have equal anchors at the same place, so a window can only be repeated
   if its anchor is.  Stretches, without text, meet by their anchor.
2. Where an anchor occurs once its windows are unique.  Stretches that are equal as a whole are repeated, and count once in
   what follows, within a batch even before they meet.  The texts of the different stretches of an anchor are fetched, and
   meet by anchor again; where they are very many they meet by more of what surrounds the anchor (see halves()).
3. Their suffixes are sorted in shards, Kasai's common prefixes tell repeated windows, and an anchor whose texts are in several
   shards is merged by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import BUCKETS_PER_TASK, PACKED, buckets_of, by_bucket, dealt, gathered, lean, mix, partitions, prepare, ranges, release_shuffles, row_key, runs_of, slices, stored, text_bytes, unplanes
from annalist.llm.suffixes import repeated
from annalist.llm.words import ODD, TABLE

KMER = 32
#: Different stretches of an anchor that meet in one task.
MOST = 20_000
#: Stretches that a task holds before it passes those of very common anchors on.
HELD = 4_000_000
#: A stretch: its anchor and content (hashes), row (doc_id and hash of the text), first byte, number of windows, anchor's place
#: in it; several: it stands for others of its batch that are equal.
STRETCH = np.dtype([("anchor", "u8"), ("content", "u8"), ("doc", "i8"), ("text", "i8"), ("start", "i4"), ("windows", "u2"), ("place", "u2"), ("several", "u1")])
#: Bytes start..end of a row: to remove (kind 0), or a stretch whose text is wanted (1, or 2 if it is known to be repeated; 3
#: and 4 the same of an anchor that is too common to meet).
NEED = np.dtype([("doc", "i8"), ("text", "i8"), ("start", "i4"), ("end", "i4"), ("anchor", "u8"), ("place", "u2"), ("kind", "u1")])
KINDED = "bucket int, blob binary, kind int"


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def stretches(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(row, start, windows, anchor hash, anchor's place, content hash) of the stretches of all rows of at least depth bytes."""
    n = len(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    long = np.diff(offsets) >= depth
    if not long.any():
        return none
    h = TABLE[data]  # hashes of 1, 2, 4, ... bytes from each place
    size, level, hashes = 1, 0, {}
    while 2 * size <= depth - KMER or size < KMER:
        h = h[:-size] * ODD[level] + h[size:]
        size, level = 2 * size, level + 1
        if size == KMER:
            hashes[KMER] = mix(h)
    wide, h_wide = size, h
    small = hashes[KMER]
    span = depth - KMER + 1
    # the place makes the leftmost of equal hashes least
    key = (small & ~np.uint64(0xFFFFFF)) | np.arange(len(small), dtype=np.uint64)
    first = (least(key, span) & np.uint64(0xFFFFFF)).astype(np.int64)  # of each window of depth bytes
    starts = ranges(offsets[:-1][long], np.diff(offsets)[long] - depth + 1)
    anchor = first[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    windows = np.diff(np.r_[head, len(starts)])
    start, anchor = starts[head], anchor[head]
    length = windows + depth - 1
    # three hashes of ``wide`` bytes cover a stretch (at most 2 depth - KMER bytes)
    content = np.zeros(len(start), np.uint64)
    pieces = int(np.ceil((2 * depth - KMER) / wide))
    for k in range(pieces):
        content = mix(content * ODD[50] + h_wide[start + (length - wide) * k // max(pieces - 1, 1)])
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start - offsets[row], windows, small[anchor], anchor - start, mix(content + length.astype(np.uint64))


def parts(data: np.ndarray, offsets: np.ndarray, depth: int, limit: int = 4 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, rows, first byte in the row) of pieces of about 1 MB; a longer row comes in overlapping pieces."""
    for a, b in slices(offsets, 1 << 20):
        own, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(own) <= limit:
            yield own, off, np.arange(a, b), np.zeros(b - a, np.int64)
            continue
        for at in range(0, len(own) - depth + 1, limit):
            piece = own[at : at + limit + depth - 1]
            yield piece, np.array([0, len(piece)]), np.array([a]), np.array([at])


def by_row(needs: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of rows."""
    return ((mix(needs["text"].view(np.uint64) + mix(needs["doc"].view(np.uint64))) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def kinded(packed: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    return pa.record_batch([*packed.columns, pa.array(np.full(packed.num_rows, kind, np.int32))], names=["bucket", "blob", "kind"])


def wanted_of(r: np.ndarray, depth: int, kind: np.ndarray) -> np.ndarray:
    out = np.empty(len(r), NEED)
    for name in ("doc", "text", "start", "anchor", "place"):
        out[name] = r[name]
    out["end"] = r["start"] + r["windows"].astype(np.int32) + (depth - 1)
    out["kind"] = kind
    return out


def texts_by_anchor(rows: list[tuple[bytes, bytes]], buckets: int) -> pa.RecordBatch:
    """(NEED, bytes of its text) as one binary row per bucket of anchors: records, then their bytes one after the other."""
    r = np.frombuffer(b"".join(x for x, _ in rows), NEED)
    bucket = ((r["anchor"] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    heads, ends = runs_of(bucket[order])
    blobs = [(y - x).to_bytes(4, "little") + b"".join(rows[k][0] for k in order[x:y]) + b"".join(rows[k][1] for k in order[x:y]) for x, y in zip(heads.tolist(), ends.tolist(), strict=True)]
    return pa.record_batch([pa.array(bucket[order][heads]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def repeated_spans(docs: DataFrame, depth: int = 200, most: int = MOST) -> DataFrame:
    """``doc``, ``hash`` with ``spans`` (int64 pairs start, end of maximal runs of bytes to remove, as binary), for the texts
    of ``docs`` (doc, hash, text; the first two name a row) in which a string of ``depth`` bytes is repeated."""
    if not KMER <= depth < 1 << 16:
        raise ValueError(f"depth must be {KMER} to {(1 << 16) - 1}")
    spark = docs.sparkSession
    tasks = partitions(spark)
    buckets = BUCKETS_PER_TASK * tasks

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 4 << 20):
            ids, hashes, (data, offsets), found = batch.column(0).to_numpy(), batch.column(1).to_numpy(), text_bytes(batch.column(2)), []
            for own, off, rows, base in parts(data, offsets, depth):
                row, start, windows, anchor, place, content = stretches(own, off, depth)
                r = np.zeros(len(row), STRETCH)
                if len(row):
                    r["anchor"], r["content"], r["doc"], r["text"], r["start"], r["windows"], r["place"] = anchor, content, ids[rows[row]], hashes[rows[row]], start + base[row], windows, place
                found.append(r)
            r = np.concatenate(found)
            # of equal stretches the first goes on, for all of them
            r = r[np.lexsort((r["content"], r["anchor"]))]
            heads, ends = runs_of(r["anchor"], r["content"])
            equal = np.repeat(ends - heads > 1, ends - heads)
            if equal.any():
                whole = wanted_of(r[equal], depth, np.zeros(int(equal.sum()), np.uint8))
                yield kinded(dealt(by_row(whole, buckets), whole), 0)
            several = ends - heads > 1
            r = r[heads]
            r["several"] = several
            yield kinded(dealt((r["anchor"] >> np.uint64(40)) % np.uint64(buckets), r), 1)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(r: np.ndarray) -> Iterator[pa.RecordBatch]:
            r = r[np.lexsort((r["start"], r["text"], r["doc"], r["content"], r["anchor"]))]
            heads, ends = runs_of(r["anchor"])
            r = r[np.repeat(ends - heads > 1, ends - heads)]
            if not len(r):
                return
            heads, ends = runs_of(r["anchor"], r["content"])
            equal = ends - heads > 1
            anchors, _ = runs_of(r["anchor"])
            group = np.searchsorted(anchors, heads, "right") - 1
            contents = np.bincount(group)[group]
            # stretches that stand for others of their batch have had these removed
            whole = np.repeat(equal, ends - heads) & (r["several"] == 0)
            yield from sent(wanted_of(r[whole], depth, np.zeros(int(whole.sum()), np.uint8)), 0)
            known = np.maximum.reduceat(r["several"], heads).astype(bool) | equal
            kind = np.where(known, 2, 1) + np.where(contents > most, 2, 0)
            need = wanted_of(r[heads], depth, kind.astype(np.uint8))
            yield from sent(need[(contents > 1) & (contents <= most)], 1)
            yield from sent(need[contents > most], 3)

        def sent(x: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
            if len(x):
                yield kinded(dealt(by_row(x, buckets), x), kind)

        now, held, size, common = None, [], 0, np.zeros(0, np.uint64)
        for batch in batches:
            for b, blob, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not kind:  # bytes to remove, from cut()
                    yield pa.record_batch([pa.array([b], pa.int32()), pa.array([blob], pa.binary()), pa.array([0], pa.int32())], names=["bucket", "blob", "kind"])
                    continue
                if b != now:
                    if held:
                        yield from out(np.concatenate(held))
                    now, held, size, common = b, [], 0, np.zeros(0, np.uint64)
                held.append(unplanes(blob, STRETCH))
                size += len(held[-1])
                if size >= HELD:
                    r = np.concatenate(held)
                    keys, n = np.unique(r["anchor"], return_counts=True)
                    common = np.union1d(common, keys[n > most])
                    far = np.isin(r["anchor"], common)
                    yield from sent(wanted_of(r[far], depth, (3 + r["several"][far]).astype(np.uint8)), 3)
                    held, size = [r[~far]], 0
        if held:
            yield from out(np.concatenate(held))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in buckets_of(batches, NEED):
            r = r[np.lexsort((r["text"], r["doc"]))]
            heads, ends = runs_of(r["doc"], r["text"])
            yield pa.record_batch([pa.array(r["doc"][heads]), pa.array(r["text"][heads]), pa.array([r[x:y].tobytes() for x, y in zip(heads, ends, strict=True)], pa.binary())], names=["doc", "hash", "needs"])

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for k, needs in enumerate(batch.column(1).to_pylist()):
                r, own = np.frombuffer(needs, NEED), data[offsets[k] : offsets[k + 1]].tobytes()
                for i in range(len(r)):
                    yield r[i].tobytes(), own[r["start"][i] : r["end"][i]]

    def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in fetched(batches):
            held.append(row)
            size += len(row[1])
            if size > 8 << 20:
                yield texts_by_anchor(held, buckets)
                held, size = [], 0
        if held:
            yield texts_by_anchor(held, buckets)

    def sorted_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            records, texts = [], []
            for blob in blobs:
                n = int.from_bytes(blob[:4], "little")
                records.append(np.frombuffer(blob, NEED, n, 4))
                texts.append(np.frombuffer(blob, np.uint8, offset=4 + n * NEED.itemsize))
            r, data = np.concatenate(records), np.concatenate(texts)
            length = (r["end"] - r["start"]).astype(np.int64)
            begin = np.cumsum(length) - length
            order = np.argsort(r["anchor"], kind="stable")
            data = data[ranges(begin[order], length[order])]
            r, length = r[order], length[order]
            begin = np.cumsum(length) - length
            heads, ends = runs_of(r["anchor"])
            group = np.repeat(np.arange(len(heads)), ends - heads)
            hit = np.flatnonzero(repeated(data, begin, length, group, depth))
            text = np.searchsorted(begin, hit, "right") - 1
            keep = r["kind"][text] % 2 == 1  # the others are repeated as a whole, which is known
            hit, text = hit[keep], text[keep]
            if not len(hit):
                return
            fresh = np.ones(len(hit), bool)
            fresh[1:] = (hit[1:] != hit[:-1] + 1) | (text[1:] != text[:-1])
            head = np.flatnonzero(fresh)
            last = np.r_[head[1:], len(hit)] - 1
            out = np.zeros(len(head), NEED)
            out["doc"], out["text"] = r["doc"][text[head]], r["text"][text[head]]
            out["start"] = hit[head] - begin[text[head]] + r["start"][text[head]]
            out["end"] = hit[last] - begin[text[last]] + r["start"][text[last]] + depth
            yield dealt(by_row(out, buckets), out)

        now, blobs = None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != now and blobs:
                    yield from one(blobs)
                    blobs = []
                now = b
                blobs.append(blob)
        if blobs:
            yield from one(blobs)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in buckets_of(batches, NEED):
            r = r[np.lexsort((r["start"], r["text"], r["doc"]))]
            start, end = r["start"].astype(np.int64), r["end"].astype(np.int64)
            heads, ends = runs_of(r["doc"], r["text"])
            index = np.repeat(np.arange(len(heads)), ends - heads)
            # runs that touch are one: the greatest end so far in the row, made comparable between rows
            wide = int(end.max()) + 2
            reach = np.maximum.accumulate(end + index * wide) - index * wide
            fresh = np.ones(len(r), bool)
            fresh[1:] = (index[1:] != index[:-1]) | (start[1:] > reach[:-1])
            head = np.flatnonzero(fresh)
            spans = np.stack([start[head], reach[np.r_[head[1:], len(r)] - 1]], 1)
            first, last = runs_of(index[head])
            yield pa.record_batch([pa.array(r["doc"][head][first]), pa.array(r["text"][head][first]), pa.array([spans[x:y].tobytes() for x, y in zip(first, last, strict=True)], pa.binary())], names=["doc", "hash", "spans"])

    def texts_of_kind(kind: int) -> DataFrame:
        needs = by_bucket(found.where(F.col("kind") == kind).select("bucket", "blob"), tasks).mapInArrow(lean(asked), "doc long, hash long, needs binary")
        # a text that several rows share is fetched once
        return docs.join(needs, ["doc", "hash"]).dropDuplicates(["doc", "hash"]).select("text", "needs")

    found = stored(by_bucket(docs.mapInArrow(lean(cut), KINDED), tasks).mapInArrow(lean(met), KINDED), "stretches")
    release_shuffles(spark)
    texts, spans = texts_of_kind(1).mapInArrow(lean(packed_texts), PACKED), found.where("kind = 0").select("bucket", "blob")
    if not found.where("kind = 3").isEmpty():

        def hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for need, text in fetched(batches):
                held.append((need, text))
                if len(held) == 8192:
                    yield hot_batch(held, depth)
                    held = []
            if held:
                yield hot_batch(held, depth)

        more_texts, more_spans = halves(texts_of_kind(3).mapInArrow(lean(hot_rows), HOT), depth, most, buckets)
        texts, spans = texts.unionByName(more_texts), spans.unionByName(more_spans)
    more = stored(by_bucket(texts, tasks).mapInArrow(lean(sorted_), PACKED), "repeats")
    release_shuffles(spark)
    return by_bucket(spans.unionByName(more), tasks).mapInArrow(lean(joined), "doc long, hash long, spans binary")


#: A part of a stretch of a very common anchor: key, the offsets low..high that its anchor may have in a window, those first..last
#: that it has in the part's windows, the record of the stretch, its bytes, and a hash of the part's bytes.
HOT = "key long, low int, high int, first int, last int, need binary, bytes binary, whole long"


def hot_batch(rows: list[tuple[bytes, bytes]], depth: int) -> pa.RecordBatch:
    r = np.frombuffer(b"".join(x for x, _ in rows), NEED)
    last = r["place"].astype(np.int32)
    first = last - (r["end"] - r["start"] - depth)
    n = len(rows)
    columns = [pa.array(r["anchor"].view(np.int64)), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, depth - KMER, np.int32)), pa.array(first), pa.array(last), pa.array([x for x, _ in rows], pa.binary()), pa.array([t for _, t in rows], pa.binary()), pa.array(np.zeros(n, np.int64))]
    return pa.record_batch(columns, names=[c.split()[0] for c in HOT.split(", ")])


def halves(hot: DataFrame, depth: int, most: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Stretches of anchors that very many different ones share: (texts by anchor, spans to remove by row).

    The windows of a stretch have its anchor at the offsets first..last.  All windows with it at low..high have the bytes in
    common that lie in each of them, so equal windows have these equal, and meet by their hash.  Parts that nothing else
    meets are unique, parts that are all equal are repeated, few different ones go on to the suffix arrays; else low..high is
    halved, until it is one offset, where parts that meet are equal.  Keys are counted by aggregation: none gathers its rows.
    """
    names = [c.split()[0] for c in HOT.split(", ")]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, low, high, first, last, need, text, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = int(np.frombuffer(need, NEED)["place"][0])
                middle = (low + high) // 2
                for a, b in {(low, middle), (middle + 1, high)} if low < high else ():
                    x, y = max(a, first), min(b, last)
                    if x <= y:
                        inside = text[place - a : place - b + depth]
                        own = text[place - y : place - x + depth]
                        rows.append((xxhash.xxh3_64_intdigest(inside, seed=(key ^ (a << 16 | b)) & ((1 << 64) - 1)), a, b, x, y, need, text, xxhash.xxh3_64_intdigest(own, seed=x << 16 | y)))
            if rows:
                columns = list(zip(*rows, strict=True))
                signed = lambda c: pa.array(np.array(c, np.uint64).view(np.int64))
                yield pa.record_batch([signed(columns[0]), *(pa.array(c, pa.int32()) for c in columns[1:5]), pa.array(columns[5], pa.binary()), pa.array(columns[6], pa.binary()), signed(columns[7])], names=names)

    def parts_of(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
        """Needs of the parts alone, and their bytes."""
        r = np.frombuffer(b"".join(batch.column(5).to_pylist()), NEED).copy()
        first, last, place, start = (np.asarray(x, np.int64) for x in (batch.column(3), batch.column(4), r["place"], r["start"]))
        r["anchor"] = batch.column(0).to_numpy().view(np.uint64)
        r["start"], r["end"] = start + place - last, start + place - first + depth
        return r, [t[p - y : p - x + depth] for t, p, x, y in zip(batch.column(6).to_pylist(), place.tolist(), first.tolist(), last.tolist(), strict=True)]

    def to_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r, own = parts_of(batch)
                yield texts_by_anchor([(r[k].tobytes(), t) for k, t in enumerate(own)], buckets)

    def to_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, _ = parts_of(batch)
            r = r[r["kind"] == 3]
            r["kind"] = 0
            if len(r):
                yield dealt(by_row(r, buckets), r)

    now = stored(hot, "hot")
    texts = now.limit(0).select("key").selectExpr("0 as bucket", "binary('') as blob")
    spans = texts
    while not now.isEmpty():
        now = stored(now.mapInArrow(lean(split), HOT), "hot")
        sums = now.groupBy("key").agg(F.count("*").alias("n"), F.min("whole").alias("x"), F.max("whole").alias("y"), F.max(F.substring("need", -1, 1) == F.unhex(F.lit("04"))).alias("known"))
        now = stored(now.join(stored(sums.where("n > 1 or known"), "sums"), "key"), "hot")
        parts_ = lambda rule: now.where(rule).select(*names)
        spans = spans.unionByName(parts_("x = y").mapInArrow(lean(to_spans), PACKED))
        texts = texts.unionByName(parts_(f"x <> y and n <= {most}").mapInArrow(lean(to_texts), PACKED))
        now = parts_(f"x <> y and n > {most}")
    return texts, spans


def remove_repeats(docs: DataFrame, depth: int = 200, most: int = MOST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id; n_bytes (UTF-8); spans (array of start, end: maximal runs of removed
    bytes); kept (binary: the bytes that stay, one after the other).

    A byte goes if a string of ``depth`` bytes that covers it also starts anywhere else, in the same text or another; strings
    are judged on the input, and none crosses texts.  A null or empty text has no bytes.  Rows that repeat a text are other
    places, whatever their doc_ids; a null doc_id stays null.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    # a row is named by its doc_id and a hash of its text: rows that agree in both have the same bytes
    doc, text_hash = row_key()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), doc.alias("doc"), text_hash.alias("hash"))
    spans = repeated_spans(texts.select("doc", "hash", "text"), depth, most)

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            all_spans, kept = [], []
            for k, spans_ in enumerate(batch.column(2).to_pylist()):
                own = data[offsets[k] : offsets[k + 1]]
                s = np.frombuffer(spans_ or b"", np.int64).reshape(-1, 2)
                keep = np.ones(len(own), bool)
                for a, b in s:
                    keep[a:b] = False
                all_spans.append([{"start": int(a), "end": int(b)} for a, b in s])
                kept.append(own[keep].tobytes())
            yield pa.record_batch([batch.column(0), pa.array(np.diff(offsets)), pa.array(all_spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return texts.join(spans, ["doc", "hash"], "left").select("doc_id", "text", "spans").mapInArrow(lean(applied), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")

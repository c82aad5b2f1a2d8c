"""Exact Jaccard near-duplicates over word shingles: PartEnum signatures, exact checks, connected components.

Two sets of at most ``r`` elements with Jaccard similarity of at least ``num / den`` differ in at most
``k = 2 r (den - num) / (den + num)`` elements.  Sizes are cut into bands so narrow that similar sets lie in the same or the
next band.  For a band the domain of shingles is cut by hash into ``n1`` parts and each part into three; a signature is the
content of two of the three, for every part and every choice.  With ``n1 > k / 2`` some part has at most one differing
element, and the two thirds without it are the same in both sets: they share that signature (Arasu et al. 2006).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import BUCKETS_PER_TASK, PACKED, buckets_of, by_bucket, dealt, dropped, free, gathered, lean, mix, partitions, prepare, ranges, release_shuffles, row_key, runs_of, slices, stored, text_bytes
from annalist.llm.components import components
from annalist.llm.words import LOWER, distinct_rows, shingles, word_bounds, word_hashes

#: Parts beyond those needed.  Two similar sets agree in SPARE + 1 parts at least, so signatures of no elements, which
#: unrelated sets share, are only needed from sets with more than SPARE parts that are so empty.
SPARE = 1
#: Set hashes that a task remembers, so as to sign copies of a set once.
SEEN = 200_000
#: Elements seen this often, by counts of those that come twice in 8 MB of sets, are common; so many are sent to all tasks
#: at most.  What is common changes how much is compared, not the result.
COMMON, MOST_COMMON = 24, 500_000
#: Ids that are sent to all tasks at most; more are joined by a shuffle.
BROADCAST = 2_000_000
#: So many of a task's sets with one signature, of 500,000 signatures at a time, are passed on as one.
COLLAPSE = 64
#: Sets that a task compares with each other at a time; a larger group goes to several tasks, in blocks.
BLOCK = 1024
#: A set's number: its row, below the level of its number of elements that aren't common, so that the least in a group is
#: the one with the fewest changes; a row: the partition that read it, and its place there.
ROW_BITS, PLACE_BITS = 50, 30
ROW_MASK = (1 << ROW_BITS) - 1
PAIR = np.dtype([("a", "i8"), ("b", "i8")])


class Bands:
    """Size bands for a threshold: band i has sizes low[i]..high[i]; differ[i] bounds the differing elements of two
    similar sets of the bands i - 1 and i."""

    def __init__(self, num: int, den: int, largest: int):
        self.low, self.high = [1], [den // num]
        while self.high[-1] < largest or len(self.high) < 2:
            self.low.append(self.high[-1] + 1)
            self.high.append(self.low[-1] * den // num)
        self.low.append(self.high[-1] + 1)
        self.high.append(self.low[-1] * den // num)
        self.differ = np.array([2 * r * (den - num) // (den + num) for r in self.high], np.int64)
        self.starts = np.array(self.low, np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, sizes, "right") - 1


def signatures(x: np.ndarray, sizes: np.ndarray, rare: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) of all sets: ``x`` has their elements one set after the other, ascending distinct hashes.

    Elements that aren't ``rare`` are left out of signatures: taking the same elements from two sets does not make them
    differ more.  A set that is left with too few to tell it from others also signs with all its elements, so two of them meet.
    """
    if not len(x):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bands = Bands(num, den, int(sizes.max()))
    band, out, owner = bands.of(np.maximum(sizes, 1)), [], np.repeat(np.arange(len(sizes)), sizes)
    for more in (0, 1):
        level = band + more
        k = bands.differ[level]
        # k = 0: only equal sets, which are found by their hash
        parts = np.where((k > 0) & (sizes > 0), k // 2 + 1 + SPARE, 0)
        sig, of, weak = _sign(x, owner, rare, parts, level, 0)
        out.append((sig, of))
        again = np.where(weak > SPARE, parts, 0)
        if again.any():
            out.append(_sign(x, owner, np.ones(len(x), bool), again, level, 1)[:2])
    return np.concatenate([s for s, _ in out]), np.concatenate([o for _, o in out])


def _sign(x: np.ndarray, owner: np.ndarray, use: np.ndarray, parts: np.ndarray, level: np.ndarray, form: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, their sets, and each set's number of parts with a signature of no element; of the sets with parts, by the
    elements in use.  With form 1, sets with more than SPARE such parts have the signatures of no element too."""
    total, base = int(parts.sum()), np.cumsum(parts) - parts
    use = use & (parts[owner] > 0)
    x, owner = x[use], owner[use]
    of = np.repeat(np.arange(len(parts)), parts)
    # sets are ascending, so parts of the domain are stretches of them
    cell = base[owner] + (((x >> np.uint64(32)) * parts[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    at = np.searchsorted(cell, np.arange(total + 1))
    third = ((x & np.uint64(0xFFFFFFFF)) * np.uint64(3)) >> np.uint64(32)
    sums, numbers = [], []
    for t in range(3):
        s = np.r_[np.uint64(0), np.cumsum(np.where(third == t, x, np.uint64(0)), dtype=np.uint64)]
        c = np.r_[0, np.cumsum(third == t)]
        sums.append(s[at[1:]] - s[at[:-1]])
        numbers.append(c[at[1:]] - c[at[:-1]])
    whole, number = sums[0] + sums[1] + sums[2], numbers[0] + numbers[1] + numbers[2]
    empty = [number == n for n in numbers]
    weak = np.bincount(of[empty[0] | empty[1] | empty[2]], minlength=len(parts))
    place = np.arange(total) - base[of]
    out = []
    for t in range(3):
        tag = mix(((level[of].astype(np.uint64) << np.uint64(34)) | (place.astype(np.uint64) << np.uint64(3))) + np.uint64(2 * t + form))
        keep = ~empty[t] | (weak[of] > SPARE) if form else ~empty[t]
        out.append((mix(whole - sums[t] + tag)[keep], of[keep]))
    return np.concatenate([s for s, _ in out]), np.concatenate([o for _, o in out]), weak


def blob(keys: np.ndarray, numbers: np.ndarray) -> bytes:
    """Signatures and sets' numbers, by row: four bytes of each key, the steps from row to row and the levels above them, byte
    by byte, so that the shuffle's compression finds the zeros.  Keys that agree in so few bytes only mean more checks."""
    row = numbers & ROW_MASK
    order = np.argsort(row, kind="stable")
    keys, row, level = keys[order], row[order], (numbers[order] >> ROW_BITS).astype(np.uint8)
    steps = np.diff(row, prepend=row[:1])
    return row[:1].tobytes() + keys.view(np.uint8).reshape(-1, 8)[:, :4].T.tobytes() + steps.view(np.uint8).reshape(-1, 8).T.tobytes() + level.tobytes()


def unblob(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    n = (len(raw) - 8) // 13
    keys = np.ascontiguousarray(raw[8 : 8 + 4 * n].reshape(4, n).T).view(np.uint32).ravel()
    steps = np.ascontiguousarray(raw[8 + 4 * n : 8 + 12 * n].reshape(8, n).T).view(np.int64).ravel()
    row = np.cumsum(steps) + np.frombuffer(data, np.int64, 1)[0]
    return keys, row + (raw[8 + 12 * n :].astype(np.int64) << ROW_BITS)


def levels(rare: np.ndarray) -> np.ndarray:
    """Numbers of elements as levels below 256, in the same order."""
    return np.minimum((8 * np.log2(rare + 1)).astype(np.int64), 255)


def member_of(x: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    return ascending[np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)] == x if len(ascending) else np.zeros(len(x), bool)


def row_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each row."""
    data = LOWER[data]
    starts, ends, counts = word_bounds(data, offsets)
    return distinct_rows(*shingles(word_hashes(data, starts, ends), counts, size))


def pack_set(s: np.ndarray) -> bytes:
    """Ascending elements byte by byte and compressed: their first bytes repeat.  The number of elements comes first."""
    return len(s).to_bytes(4, "little") + CODEC.compress(s.view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True) if len(s) else b""


def unpack_set(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    n = int.from_bytes(blob[:4], "little")
    raw = np.frombuffer(CODEC.decompress(memoryview(blob)[4:], 8 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(np.uint64).ravel()


def elements_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The elements of packed sets, one set after the other, and the sets' sizes."""
    sets = [unpack_set(b) for b in column.to_pylist()]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.array(list(map(len, sets)), np.int64)


def sketch(s: np.ndarray) -> bytes:
    """A bit for each element, at its hash, of 4 to 8 times as many bits; a power of two, 64 at least."""
    bits = np.zeros(max(64, 1 << (4 * len(s) - 1).bit_length()) if len(s) else 64, bool)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches (a row each) with the same bits at ``width`` bytes."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] | sketches[:, half:]
    return sketches


def may_link(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sketches x and y (rows of one width) of sets of nx and ny elements leave a link possible: a bit that only one
    of two sets has is an element that the other lacks."""
    same = np.bitwise_count(x & y).sum(-1, dtype=np.int64)
    most = np.minimum(nx - np.bitwise_count(x).sum(-1, dtype=np.int64) + same, ny - np.bitwise_count(y).sum(-1, dtype=np.int64) + same)
    return den * most >= num * (nx + ny - most)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    return int(s.sum(dtype=np.uint64)), int(mix(s).sum(dtype=np.uint64))


def tables(blobs: list[bytes]) -> np.ndarray:
    """Sketches of one width as rows of 64-bit words."""
    return np.frombuffer(b"".join(blobs), np.uint64).reshape(len(blobs), -1)


#: Of packed sets.
CODEC = pa.Codec("zstd", 1)

SETS = "row long, doc_id long, doc long, hash long, n_shingles long, h1 long, h2 long, shingles binary"


def sets_of(texts: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, text, doc, hash; the last two name a row) with a number of their own and the set of their shingles, stored:
    row, doc_id, doc, hash, n_shingles, h1 and h2 (hashes of the whole set), shingles (ascending hashes, packed)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        if part >> (ROW_BITS - PLACE_BITS):
            raise ValueError("too many partitions")
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets, 1 << 20):
                sets = row_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                h = np.array([set_hash(s) for s in sets], np.uint64).view(np.int64).reshape(-1, 2)
                if at + b - a >> PLACE_BITS:
                    raise ValueError("too many rows in a partition")
                row = (part << PLACE_BITS) + np.arange(at, at + b - a)
                at += b - a
                yield pa.record_batch([pa.array(row), *(batch.column(c).slice(a, b - a) for c in (0, 2, 3)), pa.array(list(map(len, sets)), pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([pack_set(s) for s in sets], pa.binary())], names=[c.split()[0] for c in SETS.split(", ")])

    return stored(texts.mapInArrow(lean(made), SETS), "sets")


def common_elements(sets: DataFrame) -> np.ndarray:
    """The most common elements, ascending."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            x, n = np.unique(elements_of(batch.column(0))[0], return_counts=True)
            yield pa.record_batch([pa.array(x[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["x", "n"])

    often = sets.select("shingles").mapInArrow(lean(counted), "x long, n long").groupBy("x").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "x").limit(MOST_COMMON)
    return np.sort(often.select("x").toPandas()["x"].to_numpy(np.int64).view(np.uint64))


def stars_of(sets: DataFrame, copies: DataFrame, common: np.ndarray, num: int, den: int, collapse: int = COLLAPSE) -> DataFrame:
    """Of every group of sets that share a signature, its least set a with each other b, as rows; and a's level.
    Stored, every pair once.  ``copies`` (row) need not sign; where they are too many to be sent to all tasks, they may.

    Where a task has many sets of one signature it passes on the least of them; the others are (``part``) its own, and
    belong to all groups that the least one turns out to be in.  So no group of any size meets in one task.
    """
    width = partitions(sets.sparkSession)
    buckets, fewer = BUCKETS_PER_TASK * width, width // 8 + 1  # pairs are few beside signatures: small blobs would outnumber them
    schema = PACKED + ", part boolean"

    def batch_of(bucket: np.ndarray, blobs: list[bytes], part: bool) -> pa.RecordBatch:
        return pa.record_batch([pa.array(bucket.astype(np.int32)), pa.array(blobs, pa.binary()), pa.array([part] * len(blobs), pa.bool_())], names=["bucket", "blob", "part"])

    def starred(a: np.ndarray, b: np.ndarray, part: bool) -> pa.RecordBatch:
        records = np.empty(len(a), PAIR)
        records["a"], records["b"] = a, b
        records = np.unique(records)
        packed = dealt((mix(records["a"].astype(np.uint64) * np.uint64(31) + records["b"].astype(np.uint64)) % np.uint64(fewer)).astype(np.int64), records)
        return batch_of(packed.column(0).to_numpy(), packed.column(1).to_pylist(), part)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            rows, hashes = batch.column(0).to_numpy(), list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            fresh = np.zeros(len(rows), bool)
            for i, h in enumerate(hashes):
                if h not in seen:
                    seen.add(h)
                    fresh[i] = True
            if len(seen) > SEEN:
                seen.clear()
            own = batch.filter(pa.array(fresh))
            _, offsets = text_bytes(own.column(3))
            for a, b in slices(offsets, 1 << 20):
                x, sizes = elements_of(own.column(3).slice(a, b - a))
                rare = ~member_of(x, common)
                heads = np.cumsum(sizes) - sizes
                numbers = rows[fresh][a:b] + (levels(np.add.reduceat(rare.astype(np.int64), heads)) << ROW_BITS)
                sig, of = signatures(x, sizes, rare, num, den)
                held.append((sig, numbers[of]))
                if sum(len(s) for s, _ in held) > 500_000:
                    yield from out(held)
                    held = []
        if held:
            yield from out(held)

    def out(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sig, number = np.concatenate([s for s, _ in held]), np.concatenate([n for _, n in held])
        order = np.lexsort((number, sig))
        sig, number = sig[order], number[order]
        heads, ends = runs_of(sig)
        many = ends - heads >= collapse
        if many.any():
            n = (ends - heads)[many] - 1
            at = ranges(heads[many] + 1, n)
            yield starred(np.repeat(number[heads[many]], n), number[at], True)
            keep = np.ones(len(sig), bool)
            keep[at] = False
            sig, number = sig[keep], number[keep]
        bucket = (sig >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, sig, number = bucket[order], sig[order], number[order]
        heads, ends = runs_of(bucket)
        yield batch_of(bucket[heads], [blob(sig[x:y], number[x:y]) for x, y in zip(heads, ends, strict=True)], False)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of the groups of a bucket."""

        def groups_of(blobs: list[bytes]) -> pa.RecordBatch:
            both = [unblob(p) for p in blobs]
            key, number = np.concatenate([k for k, _ in both]), np.concatenate([n for _, n in both])
            order = np.lexsort((number, key))
            key, number = key[order], number[order]
            first, _ = runs_of(key, number)
            key, number = key[first], number[first]
            heads, ends = runs_of(key)
            n = ends - heads - 1
            return starred(np.repeat(number[heads], n), number[ranges(heads + 1, n)], False)

        now, blobs = None, []
        for batch in batches:
            for b, data, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part:
                    r = np.concatenate(list(buckets_of([pa.record_batch([pa.array([b]), pa.array([data], pa.binary())], names=["bucket", "blob"])], PAIR)))
                    yield starred(r["a"], r["b"], True)
                    continue
                if b != now and blobs:
                    yield groups_of(blobs)
                    blobs = []
                now = b
                blobs.append(data)
        if blobs:
            yield groups_of(blobs)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in buckets_of(batches, PAIR):
            records = np.unique(records)
            yield pa.record_batch([pa.array(records["a"]), pa.array(records["b"])], names=["a", "b"])

    def pairs_of(packed: DataFrame) -> DataFrame:
        return by_bucket(packed.select("bucket", "blob"), fewer).mapInArrow(lean(distinct), "a long, b long")

    some = sets.where("n_shingles > 0").select("row", "h1", "h2", "shingles")
    if copies.count() <= BROADCAST:
        some = some.join(F.broadcast(copies.select("row")), "row", "left_anti")
    some = some.mapInArrow(lean(signed), schema)
    packed = stored(by_bucket(some, width).mapInArrow(lean(grouped), schema), "pairs")
    release_shuffles(sets.sparkSession)
    stars = stored(pairs_of(packed.where("not part")), "stars")
    if packed.where("part").limit(1).count():
        own = stored(pairs_of(packed.where("part")), "stars")
        # a collapsed set is in the groups of the set that stands for it
        more = own.select(F.col("a").alias("via"), "b").join(stars.select("a", F.col("b").alias("via")), "via").select("a", "b")
        stars = stored(stars.unionByName(own).unionByName(more).where("a <> b").distinct(), "stars")
    return stars.select(F.col("a").bitwiseAND(F.lit(ROW_MASK)).alias("a"), F.col("b").bitwiseAND(F.lit(ROW_MASK)).alias("b"), F.shiftright("a", ROW_BITS).alias("level"))


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, collapse: int = COLLAPSE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    A text's set: the distinct runs of ``size`` words (ASCII white space between them, A-Z lower-cased); all words if there
    are fewer.  Two rows link when their sets' Jaccard similarity is at least num / den, or when they have one doc_id and
    both have words; component_id is the smallest doc_id reachable by links, its own included.  A null, empty or blank text
    has no set and links with nothing: component_id is its doc_id.  A null doc_id is no doc_id: such a row is linked by its
    text alone, and its component_id is null if nothing that it reaches has a doc_id.  An empty table gives an empty result.

    Nothing is approximated and no group is capped.  Copies of a set are linked through their hash, without pairs.  In a
    group that shares a signature the set with the fewest changes (see ROW_BITS) is checked against every other.  Sets of a
    group that are then in one component need no check; the others are compared with each other, by sketches that are never
    too strict, in blocks, and what may link is checked.
    """
    return classes(docs, size, num, den, collapse, block).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group that near_duplicates() links: that of the smallest doc_id (a null one last), of
    several with this doc_id that of the least text hash; all rows without words.  Columns as they were."""
    rows = classes(docs, size, num, den).where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull(), "doc", "hash")
    group = F.coalesce("component", "row")
    rep = stored(rows.groupBy(group.alias("group")).agg(F.min(order).alias("rep"), F.count("*").alias("n")).where("n > 1"), "groups")
    rows = rows.withColumn("group", group).join(rep, "group")
    names = [free(n, docs.columns) for n in ("doc", "hash")]
    keys = lambda rule: rows.where(rule).select(F.col("doc").alias(names[0]), F.col("hash").alias(names[1]))
    gone, stay = small(keys(order != F.col("rep")).distinct()), keys(order == F.col("rep"))
    doc, text_hash = row_key()
    kept = docs.withColumns({names[0]: doc, names[1]: text_hash}).join(gone, names, "left_anti")
    # rows that repeat both doc_id and text: one of them
    twice = stored(stay.groupBy(names).agg(F.count("*").alias("n")).where("n > 1").select(names), "twice")
    if not twice.isEmpty():
        twice = small(twice)
        kept = kept.join(twice, names, "left_anti").unionByName(kept.join(twice, names, "left_semi").dropDuplicates(names))
    return kept.drop(*names)


def classes(docs: DataFrame, size: int, num: int, den: int, collapse: int = COLLAPSE, block: int = BLOCK) -> DataFrame:
    """Of all rows: row, doc_id, doc, hash, n_shingles, component (a row that stands for the component; null of a row that
    nothing is linked with) and component_id.  Stored."""
    prepare(docs.sparkSession)
    doc, text_hash = row_key()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), doc.alias("doc"), text_hash.alias("hash"))
    sets = sets_of(texts, size)
    common = common_elements(sets)
    # copies (row, rep): rows whose set an earlier row has; from here on the earliest stands for all
    keyed = sets.where("n_shingles > 0").select("row", "h1", "h2")
    same = stored(keyed.groupBy("h1", "h2").agg(F.min("row").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), "same")
    copies = stored(keyed.join(same, ["h1", "h2"]).where("row <> rep").select("row", "rep"), "copies")
    stars = stored(of_reps(stars_of(sets, copies, common, num, den, collapse), copies), "stars")
    release_shuffles(docs.sparkSession)
    # the least partner of every set first
    least = stored(stars.groupBy("b").agg(F.min(F.struct("level", "a")).alias("x")).select("x.a", "b"), "least")
    first = checked(sets, least, num, den)
    # then the least of a group with those of its group in another component
    apart = named_ends(stars, components(first)).where("component <> component_a").join(least, ["a", "b"], "left_anti")
    more = stored(apart.select("a", "b"), "apart")
    del apart
    release_shuffles(docs.sparkSession)
    links = first.unionByName(checked(sets, more, num, den))
    # what is left: groups whose other sets are in several components
    groups = stored(open_groups(named_ends(stars, components(links))), "open")
    if not groups.isEmpty():
        links = links.unionByName(linked(sets, rest_of(sets, groups, common, num, den, block), num, den))
    out = stored(labelled(sets, copies, links), "near")
    dropped(sets, same, copies, stars, least, links)
    return out


def of_reps(stars: DataFrame, copies: DataFrame) -> DataFrame:
    """Pairs between the rows that stand for their sets."""
    of = lambda end: copies.select(F.col("row").alias(end), F.col("rep").alias(f"r{end}"))
    ends = stars.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), "level")
    return ends.where("a <> b").distinct()


def labelled(sets: DataFrame, copies: DataFrame, links: DataFrame) -> DataFrame:
    """What classes() returns, from links (a, b) between rows that stand for their sets."""
    rows = sets.where("n_shingles > 0").select("row", "doc_id")
    named = rows.join(copies, "row", "left").select("row", "doc_id", F.coalesce("rep", "row").alias("rep"))
    twice = named.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select(F.col("doc_id").alias("twin"), "a")
    twins = named.join(stored(twice, "twins"), F.col("doc_id") == F.col("twin")).select("a", F.col("rep").alias("b"))
    final = components(links.unionByName(twins))
    # a set on several rows without a link is a component too
    alone = copies.select("rep").distinct().join(final, F.col("rep") == F.col("id"), "left_anti").select(F.col("rep").alias("id"), F.col("rep").alias("component"))
    member = stored(named.join(stored(final.unionByName(alone), "components").withColumnRenamed("id", "rep"), "rep").select("row", "doc_id", "component"), "members")
    low = stored(member.groupBy("component").agg(F.min("doc_id").alias("component_id")), "labels")
    label = member.join(low, "component").select("row", "component", "component_id")
    out = sets.select("row", "doc_id", "doc", "hash", "n_shingles").join(label, "row", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def named_ends(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """Pairs (a, b) with component_a and component (of b); an id that ``part`` (id, component) lacks is its own."""
    ends = pairs.join(part.withColumnsRenamed({"id": "a", "component": "component_a"}), "a", "left").join(part.withColumnRenamed("id", "b"), "b", "left")
    return ends.select("a", "b", F.coalesce("component_a", "a").alias("component_a"), F.coalesce("component", "b").alias("component"))


def open_groups(named: DataFrame) -> DataFrame:
    """(a, b, component) of the groups whose sets b are in several components."""
    split = named.groupBy("a").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("a")
    return named.join(split, "a").select("a", "b", "component")


def rest_of(sets: DataFrame, groups: DataFrame, common: np.ndarray, num: int, den: int, block: int) -> DataFrame:
    """Pairs (a, b) of sets of one of the ``groups`` (a, b, component) and different components that may link.

    They are compared by their sketches, within their groups, those of one that is larger than a block in blocks.  Before,
    a prefix filter thins large groups out: any two sets that link share one of their first elements, rare ones first, so
    sets none of whose first elements is in a set of another component drop out.
    """

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, sizes = elements_of(batch.column(2))
            take = sizes - -(-num * sizes // den) + 1
            heads = np.cumsum(sizes) - sizes
            order = np.lexsort((x, member_of(x, common), np.repeat(np.arange(len(sizes)), sizes)))
            own = x[order][ranges(heads, take)].view(np.int64)
            yield pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), take)), pa.array(np.repeat(batch.column(1).to_numpy(), take)), pa.array(own)], names=["row", "component", "element"])

    count = groups.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    counts = stored(count, "blocks")
    large = groups.join(counts.where("blocks > 1"), "a")
    left = groups.join(counts.where("blocks = 1"), "a")
    if not large.isEmpty():
        member = large.select(F.col("b").alias("row"), "component").distinct()
        entry = stored(sets.select("row", "shingles").join(small(member), "row").select("row", "component", "shingles").mapInArrow(lean(firsts), "row long, component long, element long"), "firsts")
        shared = stored(entry.groupBy("element").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("element"), "shared")
        meet = stored(entry.join(shared, "element", "left_semi").select(F.col("row").alias("b")).distinct(), "meet")
        release_shuffles(sets.sparkSession)
        thin = stored(open_groups(large.join(small(meet), "b").select("a", "b", "component")), "thin")
        left = left.unionByName(thin.join(stored(thin.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "blocks"), "a"))
    # block i meets block j >= i in task (i, j) of its group
    mine = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = left.withColumn("mine", mine).withColumn("other", other).select("a", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.col("b").alias("row"), "component", "mine")
    brief = sketches(sets, groups.select(F.col("b").alias("row")).distinct())
    cells = cells.join(brief, "row").select("a", "i", "j", "mine", "row", "component", "n_shingles", "sketch")
    out = stored(cells.repartition("a", "i", "j").sortWithinPartitions("a", "i", "j").mapInArrow(lean(lambda batches: compared(batches, num, den)), "a long, b long").distinct(), "rest")
    dropped(brief)
    del cells, brief
    release_shuffles(sets.sparkSession)
    return out


def sketches(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """row, n_shingles and sketch of some rows, stored."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sketch(unpack_set(b)) for b in batch.column(2).to_pylist()]
            yield pa.record_batch([*batch.columns[:2], pa.array(own, pa.binary())], names=["row", "n_shingles", "sketch"])

    some = sets.select("row", "n_shingles", "shingles").join(small(rows), "row", "left_semi")
    return stored(some.mapInArrow(lean(drawn), "row long, n_shingles long, sketch binary"), "sketches")


def compared(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs of rows (a, i, j, mine, row, component, n, sketch; those of one (a, i, j) together) of different components
    that their sketches let link; where i < j, one of block i and one of block j."""
    now, held = None, []

    def found() -> pa.RecordBatch:
        mine, row, component, n = (np.array([h[k] for h in held], np.int64) for k in range(4))
        width = np.array([len(h[4]) for h in held])
        pairs: list[np.ndarray] = []
        for w in np.unique(width):
            x = np.flatnonzero(width == w)
            own = tables([held[k][4] for k in x])
            for v in np.unique(width[width >= w]):
                y = np.flatnonzero(width == v)
                others = folded(tables([held[k][4] for k in y]), own.shape[1])
                for k, at in enumerate(x):
                    meet = (component[y] != component[at]) & ((y > at) | (width[y] != w)) & ((now[1] == now[2]) | (mine[y] != mine[at]))
                    meet &= den * np.minimum(n[y], n[at]) >= num * np.maximum(n[y], n[at])
                    to = np.flatnonzero(meet)
                    if len(to):
                        to = to[may_link(own[k], others[to], n[at], n[y[to]], num, den)]
                        pairs.append(np.stack([np.full(len(to), row[at]), row[y[to]]], 1))
        both = np.sort(np.concatenate(pairs), axis=1) if pairs else np.zeros((0, 2), np.int64)
        return pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for batch in batches:
        for a, i, j, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (a, i, j) != now and held:
                yield found()
                held = []
            now = (a, i, j)
            held.append(rest)
    if held:
        yield found()


def checked(sets: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of rows, stored before, that link: by sizes and sketches first, then by their elements."""
    if pairs.isEmpty():
        return pairs

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            nx, ny = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            xs, ys = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            width = np.minimum([len(x) for x in xs], [len(y) for y in ys]) if len(xs) else np.zeros(0, np.int64)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                x, y = (np.concatenate([folded(tables([t[k]]), w // 8) for k in at]) for t in (xs, ys))
                keep[at] = may_link(x, y, nx[at], ny[at], num, den)
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep))

    brief = sketches(sets, ends_of(pairs))
    both = pairs.join(brief.select(F.col("row").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa")), "a").join(brief.select(F.col("row").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb")), "b")
    near = both.where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)").select("a", "b", "na", "nb", "sa", "sb")
    near = stored(near.mapInArrow(lean(likely), "a long, b long"), "likely")
    dropped(brief)
    del brief, both  # their plans hold the shuffles
    release_shuffles(sets.sparkSession)
    return linked(sets, near, num, den)


def linked(sets: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of rows, stored before, whose sets' similarity is at least num / den."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.sort(np.concatenate([unpack_set(x), unpack_set(y)]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(den * same >= num * (len(both) - same))
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    whole = stored(sets.select("row", "shingles").join(small(ends_of(pairs)), "row", "left_semi"), "shingles")
    both = pairs.join(whole.withColumnsRenamed({"row": "a", "shingles": "sa"}), "a").join(whole.withColumnsRenamed({"row": "b", "shingles": "sb"}), "b")
    out = stored(both.select("a", "b", "sa", "sb").mapInArrow(lean(verified), "a long, b long"), "linked")
    dropped(whole)
    del whole, both  # their plans hold the shuffles
    release_shuffles(sets.sparkSession)
    return out


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()


def small(ids: DataFrame) -> DataFrame:
    """Distinct rows, stored; sent to all tasks in a join if they are at most BROADCAST."""
    ids = stored(ids, "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST else ids

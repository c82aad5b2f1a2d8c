"""Benchmark passages in documents: spaced seeds find them despite substituted words, an alignment verifies them.

The hashes of all seeds of the items are joined with those of the documents.  Up to BLOCK_BYTES of item text, which is measured
before, the items' side of the join is sent to every task and documents are read once, without a shuffle.  A larger benchmark's
seeds stay a table: a bitmap of bounded size drops most of the documents' seeds, the others are joined by a shuffle, and the
texts of the pairs that meet are fetched and verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import free, lean, mix, prepare, ranges, row_key, slices, stored, text_bytes, texts_of
from annalist.llm.words import ODD, SIGNS, word_bounds, word_hashes

#: Seeds: runs of words, of which those at 1 count.  An overlap of LEAST_WORDS words or more, LEAST_SHARE of them equal wherever
#: the others stand, has at least one of them whole; the tests count this out.
MASKS = ("1111011", "1110100011", "10010010111", "1110000100011", "1100010001011", "101100010101", "1111101")
#: The same for items that are shorter, by their number of words: of these LEAST_SHARE of all words must be equal.
SHORT_MASKS = {
    5: ("1111", "11101", "11011", "10111"),
    6: ("1111", "11011"),
    7: ("11111", "111011", "110111"),
    8: ("11011", "1111", "1100011"),
    9: ("111011", "1001111", "11010011", "111101"),
    10: ("111011", "11010011", "11111"),
    11: ("1101011", "1110011"),
    12: ("111011", "110100011", "11001011", "110111"),
}
#: An overlap: as many words in a row, this share of them equal.
LEAST_WORDS = 13
LEAST_SHARE = 0.75
#: Shorter items can't be told from chance and match nothing.
SHORTEST = min(SHORT_MASKS)
#: Pairs of places that are held at a time.
PAIRS = 4 << 20
#: Bytes of benchmark text whose seeds are sent to every task.
BLOCK_BYTES = 16 << 20
#: Bits of the bitmap of a larger benchmark's seeds.
BITMAP = 27


@dataclass
class Seeds:
    """Words of benchmark items and the hashes of their seeds, ascending, with the item's index and the word's place; a seed at
    ``length`` places in a row of an item is one entry."""

    ids: list[int]
    words: np.ndarray
    starts: np.ndarray  # of items in words, one more at the end
    keys: dict[str, np.ndarray]
    item: dict[str, np.ndarray]
    place: dict[str, np.ndarray]
    length: dict[str, np.ndarray]


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' words (lower case; ASCII signs between them), and the rows' numbers of them."""
    data, offsets = text_bytes(pc.utf8_lower(column))
    starts, ends, counts = word_bounds(data, offsets, SIGNS)
    return word_hashes(data, starts, ends), counts


def seed_hashes(words: np.ndarray, counts: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that a mask counts, at every place where it lies within its row, and those places."""
    span = len(mask)
    ends = np.cumsum(counts)
    n = np.maximum(counts - span + 1, 0)
    at = ranges(ends - counts, n)
    out = np.zeros(max(len(words) - span + 1, 0), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += words[k : k + len(out)] * ODD[k]
    return mix(out[at] if len(at) < len(out) else out), at


def masks_of(sizes: set[int]) -> dict[str, set[int]]:
    """The masks that items of such numbers of words need, with those numbers; LEAST_WORDS stands for all from there on."""
    out: dict[str, set[int]] = {}
    for n in sorted({min(n, LEAST_WORDS) for n in sizes if n >= SHORTEST}):
        for mask in MASKS if n == LEAST_WORDS else SHORT_MASKS[n]:
            out.setdefault(mask, set()).add(n)
    return out


def seeds_of(items: list[tuple[int, str]]) -> Seeds:
    words, counts = words_of(pa.array([t or "" for _, t in items], pa.string()))
    starts = np.r_[0, np.cumsum(counts)]
    keys, item, place, length = {}, {}, {}, {}
    for mask, sizes in masks_of(set(counts.tolist())).items():
        h, at = seed_hashes(words, counts, mask)
        own = np.isin(np.minimum(counts, LEAST_WORDS)[np.searchsorted(starts, at, "right") - 1], list(sizes))
        h, at = h[own], at[own]
        of = np.searchsorted(starts, at, "right") - 1
        order = np.lexsort((at, h))
        h, of, at = h[order], of[order], (at - starts[of])[order]
        heads, n = in_a_row(at, h, of)
        keys[mask], item[mask], place[mask], length[mask] = h[heads], of[heads], at[heads], n
    return Seeds([i for i, _ in items], words, starts, keys, item, place, length)


def in_a_row(at: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of entries whose keys are equal and whose places follow each other."""
    fresh = np.ones(len(at), bool)
    if len(at):
        fresh[1:] = at[1:] != at[:-1] + 1
        for key in keys:
            fresh[1:] |= key[1:] != key[:-1]
    heads = np.flatnonzero(fresh)
    return heads, np.diff(np.r_[heads, len(at)])


def best_stretch(equal: np.ndarray, least_share: float = LEAST_SHARE) -> tuple[int, int, int]:
    """Start, end and equal words of the longest stretch of which the share is equal; the first of those."""
    total = np.r_[0, np.cumsum(equal)] - least_share * np.arange(len(equal) + 1)
    low = np.minimum.accumulate(total)
    first = np.searchsorted(-low, -total - 1e-9)  # where the total was no higher for the first time
    length = np.arange(len(total)) - first
    end = int(np.argmax(length))
    start = int(first[end])
    return start, end, int(equal[start:end].sum())


def bounded(least_words: int, least_share: float) -> None:
    if least_words < LEAST_WORDS or least_share < LEAST_SHARE:
        raise ValueError(f"seeds find overlaps of {LEAST_WORDS} words and a share of {LEAST_SHARE} or more")


def overlaps(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, sent_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Verified overlaps of ``docs`` (doc_id, text) with ``benchmark`` (item_id, text), one row per document row and item:
    doc_id, item_id, doc_word and item_word (where the longest overlap starts), n_words, n_equal.

    An overlap is a stretch of ``least_words`` words or more along a diagonal, ``least_share`` of them equal, wherever the
    others stand; of an item that has fewer words, all of it.  The overlap with most equal words is told, of equal ones that
    on the diagonal with most equal words and smallest place.  Every overlap has a seed; bounds below LEAST_WORDS and
    LEAST_SHARE, for which that does not hold, are refused.  Items under SHORTEST words, null and empty texts, and items with
    a null item_id match nothing.  Repeated rows give a row each; of items with one id the best counts; a null doc_id stays
    null.  Empty tables give no rows.  Items of at most ``sent_bytes`` are sent to all tasks, else they are joined.
    """
    bounded(least_words, least_share)
    spark = docs.sparkSession
    prepare(spark)
    items = items_of(benchmark)
    if fits(items, sent_bytes):
        return texts_of(docs).mapInArrow(lean(_rows(sent(items), least_words, least_share)), ", ".join(f"{n} long" for n in NAMES))
    doc, text_hash = row_key()
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc.alias("doc"), text_hash.alias("hash"))
    return keys.join(joined(docs, items, least_words, least_share), ["doc", "hash"]).select(NAMES)


NAMES = ["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_equal"]


def items_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")


def fits(items: DataFrame, sent_bytes: int) -> bool:
    """Whether the items' texts, and their ids, are few enough to be sent to all tasks."""
    size = items.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    return size <= sent_bytes


def sent(items: DataFrame) -> Seeds:
    return seeds_of([tuple(r) for r in items.collect()])


def joined(docs: DataFrame, items: DataFrame, least_words: int, least_share: float) -> DataFrame:
    """doc and hash (of a row of docs), item_id and the best overlap of the two, by a join of seeds that stay tables."""
    items = stored(items.distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    masks = list(masks_of({*SHORT_MASKS, LEAST_WORDS}))

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = seeds_of([(k, text)])
                if not own.keys:
                    continue
                length = np.concatenate(list(own.length.values()))
                h = np.repeat(np.concatenate(list(own.keys.values())), length)
                place = ranges(np.concatenate(list(own.place.values())), length)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.full(len(h), k)), pa.array(place)], names=["seed", "item", "place"])

    seeds = stored(items.select("item", "text").mapInArrow(lean(seeded), "seed long, item long, place long"), "seeds")
    place = F.shiftrightunsigned("seed", 64 - BITMAP) + 1  # Spark's bitmaps count from 1
    marks = seeds.select(place.alias("x")).distinct().groupBy(F.expr("bitmap_bucket_number(x)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("bits"))
    bitmap = np.zeros((1 << BITMAP) // 8, np.uint8)
    for r in marks.collect():  # one row of 4 KB for 32,768 bits: as many as the bitmap has
        bitmap[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            _, offsets = text_bytes(column)
            for a, b in slices(offsets):
                words, counts = words_of(column.slice(a, b - a).fill_null(""))
                ends = np.cumsum(counts)
                found = []
                for mask in masks:
                    h, at = seed_hashes(words, counts, mask)
                    x = (h >> np.uint64(64 - BITMAP)).astype(np.int64)
                    some = np.flatnonzero(bitmap[x >> 3] >> (x & 7).astype(np.uint8) & 1)
                    row = np.searchsorted(ends, at[some], "right")
                    found.append((h[some].view(np.int64), row, at[some] - (ends - counts)[row]))
                h, row, at = (np.concatenate(f) for f in zip(*found, strict=True))
                if len(h):
                    yield pa.record_batch([batch.column(0).take(pa.array(a + row)), batch.column(1).take(pa.array(a + row)), pa.array(h), pa.array(at)], names=["doc", "hash", "seed", "at"])

    doc, text_hash = row_key()
    texts = docs.select(doc.alias("doc"), text_hash.alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    hits = stored(texts.mapInArrow(lean(met), "doc long, hash long, seed long, at long"), "hits")
    pairs = hits.join(seeds, "seed").select("doc", "hash", "item", (F.col("at") - F.col("place")).alias("diagonal"))
    # as many as a document and an item have diagonals
    pairs = stored(pairs.groupBy("doc", "hash", "item").agg(F.collect_set("diagonal").alias("diagonals")), "pairs")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            doc_words, doc_counts = words_of(batch.column(2))
            item_words, item_counts = words_of(batch.column(4))
            doc_ends, item_ends = np.cumsum(doc_counts), np.cumsum(item_counts)
            for k, diagonals in enumerate(batch.column(5).to_pylist()):
                of = doc_words[doc_ends[k] - doc_counts[k] : doc_ends[k]]
                own = item_words[item_ends[k] - item_counts[k] : item_ends[k]]
                best = max((x for d in diagonals if (x := along(own, of, d, least_words, least_share))), default=None, key=lambda x: (x[0], -x[2], -x[3]))
                if best:
                    out.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(3)[k].as_py(), *best))
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc", "hash", "item_id", "n_equal", "n_words", "doc_word", "item_word"])

    wanted = texts.join(pairs, ["doc", "hash"]).dropDuplicates(["doc", "hash", "item"])
    both = wanted.join(items.withColumnRenamed("text", "item_text"), "item").select("doc", "hash", "text", "item_id", "item_text", "diagonals")
    best = both.mapInArrow(lean(verified), "doc long, hash long, item_id long, n_equal long, n_words long, doc_word long, item_word long")
    one = best.groupBy("doc", "hash", "item_id").agg(F.max(F.struct("n_equal", "n_words", "doc_word", "item_word")).alias("x"))
    return stored(one.select("doc", "hash", "item_id", "x.*"), "overlaps")


def along(own: np.ndarray, doc: np.ndarray, diagonal: int, least_words: int, least_share: float) -> tuple[int, int, int, int] | None:
    """Equal words, words, and where the longest overlap along a diagonal starts in the document and the item, if there is one."""
    first, last = max(0, -diagonal), min(len(own), len(doc) - diagonal)
    equal = own[first:last] == doc[first + diagonal : last + diagonal]
    if len(own) < least_words:
        same = int(equal.sum())
        return (same, len(own), diagonal, 0) if len(equal) == len(own) and same >= least_share * len(own) else None
    start, end, same = best_stretch(equal, least_share)
    return (same, end - start, first + start + diagonal, first + start) if end - start >= least_words else None


def _rows(seeds: Seeds, least_words: int, least_share: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(seeds, least_words, least_share)
        for batch in batches:
            found = [(batch.column(0)[row].as_py(), *rest) for row, *rest in find(batch.column(1))]
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=NAMES)

    return rows


def decontaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, sent_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item, as overlaps() has it; columns as they were."""
    bounded(least_words, least_share)
    prepare(docs.sparkSession)
    items = items_of(benchmark)
    if not fits(items, sent_bytes):
        found = joined(docs, items, least_words, least_share).select("doc", "hash").distinct()
        names = [free(n, docs.columns) for n in ("doc", "hash")]
        doc, text_hash = row_key()
        found = found.toDF(*names)
        return docs.join(found, (doc == F.col(names[0])) & (text_hash == F.col(names[1])), "left_anti")
    at, seeds = docs.columns.index("text"), sent(items)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(seeds, least_words, least_share)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, *_ in find(batch.column(at)):
                keep[row] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lean(kept), docs.schema)


def _finder(seeds: Seeds, least_words: int, least_share: float):
    """A function from a text column to (row, item_id, doc_word, item_word, n_words, n_equal) of its verified overlaps."""
    likely, shift = {}, {}
    for mask, keys in seeds.keys.items():
        bits = max(16, min(25, (len(keys) * 256).bit_length()))
        shift[mask] = np.uint64(64 - bits)
        likely[mask] = np.zeros(1 << bits, bool)
        likely[mask][keys >> shift[mask]] = True

    def find(column: pa.Array) -> Iterator[tuple]:
        _, offsets = text_bytes(column)
        for a, b in slices(offsets):
            words, counts = words_of(column.slice(a, b - a).fill_null(""))
            ends = np.cumsum(counts)
            found = np.zeros((0, 3), np.int64)
            for mask, keys in seeds.keys.items():
                h, at = seed_hashes(words, counts, mask)
                some = np.flatnonzero(likely[mask][h >> shift[mask]])
                h, at = h[some], at[some]
                row = np.searchsorted(ends, at, "right")
                heads, length = in_a_row(at, h, row)
                h, at, row = h[heads], at[heads] - (ends - counts)[row[heads]], row[heads]
                low = np.searchsorted(keys, h)
                n = np.searchsorted(keys, h, "right") - low
                stop = np.cumsum(n)
                i = 0
                while i < len(h):  # of a word that is repeated over and over a run of diagonals is one pair
                    j = max(i + 1, int(np.searchsorted(stop, (stop[i - 1] if i else 0) + PAIRS, "right")))
                    which = ranges(low[i:j], n[i:j])
                    of, first, last = (np.repeat(x[i:j], n[i:j]) for x in (row, at, at + length - 1))
                    place = seeds.place[mask][which]
                    spans = np.unique(np.stack([of, seeds.item[mask][which], first - place - seeds.length[mask][which] + 1, last - place], 1), axis=0)
                    size = spans[:, 3] - spans[:, 2] + 1
                    each = np.repeat(spans[:, :2], size, axis=0)
                    found = np.unique(np.concatenate([found, np.c_[each, ranges(spans[:, 2], size)]]), axis=0)
                    i = j
            same = _same(seeds, words, ends, counts, found)
            some = np.flatnonzero(same >= least_share * np.minimum(least_words, np.diff(seeds.starts)[found[:, 1]]))
            found, same = found[some], same[some]
            best: dict[tuple[int, int], tuple] = {}
            order = np.lexsort((found[:, 2], -same))
            for (row, item, diagonal), most in zip(found[order].tolist(), same[order].tolist(), strict=True):
                key = (row, seeds.ids[item])
                if key in best and best[key][0] >= most:
                    continue
                doc = words[ends[row] - counts[row] : ends[row]]
                own = seeds.words[seeds.starts[item] : seeds.starts[item + 1]]
                if (x := along(own, doc, diagonal, least_words, least_share)) and x[0] > best.get(key, (0,))[0]:
                    best[key] = x
            for (row, item), (same, n, d, w) in best.items():
                yield a + row, item, d, w, n, same

    return find


def _same(seeds: Seeds, words: np.ndarray, ends: np.ndarray, counts: np.ndarray, found: np.ndarray) -> np.ndarray:
    """How many words are equal along each diagonal: few of those that a seed names by chance have enough."""
    row, item, diagonal = found.T
    size = np.diff(seeds.starts)[item]
    first, last = np.maximum(0, -diagonal), np.minimum(size, counts[row] - diagonal)
    same, stop = np.zeros(len(found), np.int64), np.cumsum(last - first)
    i = 0
    while i < len(found):
        j = max(i + 1, int(np.searchsorted(stop, (stop[i - 1] if i else 0) + PAIRS, "right")))
        n = (last - first)[i:j]
        own = ranges(seeds.starts[item[i:j]] + first[i:j], n)
        doc = ranges((ends - counts)[row[i:j]] + first[i:j] + diagonal[i:j], n)
        same[i:j] = np.add.reduceat((seeds.words[own] == words[doc]).astype(np.int64), np.cumsum(n) - n)
        i = j
    return same

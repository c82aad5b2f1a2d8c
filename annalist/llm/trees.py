"""Byte-pair encoding of whole texts, long unsplit ones by tree concatenation, and decoding.

What the vocabulary's rules don't split (a run of letters without a space, say) is one word to the merges, however long.  Such
a word is cut into leaves that are encoded in parallel, as rows of their own; then halves are joined: a window of the last
tokens on the left and the first ones on the right is encoded again, and grows until its first token is the left side's and
its last one the right side's.  That is exact: the merges that make a stretch of tokens never look beyond it, so encodings of
two stretches that share a token (and of the letters under it) go together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from annalist.llm.common import free, gathered, lean, prepare, ranges, slices, stored, text_bytes, texts_of
from annalist.llm.tokens import Encoder, tokenizer, vocabulary_path

#: Letters of a leaf: words up to this long are encoded at once.
LEAF = 4096
#: Tokens on either side of a join that are encoded again at first.
WINDOW = 4
SPACE = r"[ \t-\r]+"


class Leaves:
    """The vocabulary's merges alone, over letters of words: inside a word, and up to its end."""

    def __init__(self, path: str):
        from tokenizers import models

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.inner = models.BPE(vocab=model["vocab"], merges=pairs)
        self.final = models.BPE(vocab=model["vocab"], merges=pairs, end_of_word_suffix=model["end_of_word_suffix"])
        self.end = model["end_of_word_suffix"]
        self.letters = {i: t.removesuffix(self.end) for t, i in model["vocab"].items()}
        self.tokenizer = tokenizer(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def encode(self, letters: str, last: bool) -> np.ndarray:
        """Ids of a stretch of a word; ``last``: the word ends there."""
        return np.fromiter((t.id for t in (self.final if last else self.inner).tokenize(letters)), np.uint32)

    def words(self, run: str) -> Iterator[str | int]:
        """The words, in letters, that a text without ASCII white space falls into, and ids of special tokens in it."""
        for part in self.split.split(run) if self.split else [run]:
            if part in self.special:
                yield self.special[part]
            elif part:
                yield from (w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part)))

    def joined(self, left: np.ndarray, right: np.ndarray, last: bool) -> np.ndarray:
        """Ids of two stretches of a word, side by side, from the ids of each; ``last``: the word ends with the right one."""
        k = WINDOW
        while True:
            a, b = left[max(0, len(left) - k) :], right[:k]
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            ids = self.encode("".join(map(self.letters.__getitem__, np.r_[a, b].tolist())), last and whole_right)
            # a side that is in the window whole has nothing beyond it to agree with; two tokens at least keep the sides apart
            if len(ids) > 1 or whole_left and whole_right:
                if (whole_left or ids[0] == a[0]) and (whole_right or ids[-1] == b[-1]):
                    return np.concatenate([left[: len(left) - len(a)], ids, right[len(b) :]])
            k *= 2

    def tree(self, leaves: list[np.ndarray], last: bool = True) -> np.ndarray:
        """Ids of a word from those of its leaves: halves are joined, then halves of halves' results."""
        while len(leaves) > 1:
            n = len(leaves)
            leaves = [leaves[k] if k + 1 == n else self.joined(leaves[k], leaves[k + 1], last and k + 2 >= n) for k in range(0, n, 2)]
        return leaves[0]


@lru_cache(maxsize=1)
def leaves_of(path: str) -> Leaves:
    return Leaves(path)


def stretches(word: str, leaf: int) -> list[str]:
    """A word's leaves: halves of halves, until none is longer than ``leaf``."""
    n = 1
    while -(-len(word) // n) > leaf:
        n *= 2
    size = -(-len(word) // n)
    return [word[k : k + size] for k in range(0, len(word), size)]


def ids_column(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat.astype(np.int32)))


def encoded_batches(path: str):
    """(doc_id, text) to (doc_id, ids): texts without a long unsplit word."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in gathered(batches):
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                ids, counts = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.record_batch([batch.column(0).slice(a, b - a), ids_column(ids, counts)], names=["doc_id", "ids"])

    return lean(encode)


def cut_batches(path: str, leaf: int):
    """(row, doc_id, text) to rows (row, doc_id, part, state, letters, ids) in the order of the text: stretches of the text
    that have their ids (state 0), leaves of long words (1), and the last leaf of each (2)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, of, blank = Encoder(path), leaves_of(path), regex.compile(SPACE)

        def own(text: str) -> np.ndarray:
            data, offsets = text_bytes(pa.array([text]))
            return encoder.encode(data, offsets)[0]

        def parts(text: str) -> Iterator[tuple[int, str | None, np.ndarray | None]]:
            begun, at = 0, 0
            while at < len(text):
                space = blank.search(text, at)
                end = space.start() if space else len(text)
                if len(text[at:end].encode()) > leaf:
                    yield 0, None, own(text[begun:at])
                    short: list[np.ndarray] = []
                    for word in of.words(text[at:end]):
                        if isinstance(word, str) and len(word) > leaf:
                            yield 0, None, np.concatenate([np.zeros(0, np.uint32), *short])
                            short = []
                            *some, last = stretches(word, leaf)
                            yield from ((1, s, None) for s in some)
                            yield 2, last, None
                        else:
                            short.append(np.asarray([word], np.uint32) if isinstance(word, int) else of.encode(word, True))
                    yield 0, None, np.concatenate([np.zeros(0, np.uint32), *short])
                    begun = end
                at = space.end() if space else len(text)
            yield 0, None, own(text[begun:])

        for batch in batches:
            for k in range(batch.num_rows):
                row, doc = (batch.column(c).slice(k, 1) for c in (0, 1))
                held, size, first = [], 0, 0
                for state, letters, ids in parts(batch.column(2)[k].as_py()):
                    held.append((state, letters, None if ids is None else ids.astype("<u4").tobytes()))
                    size += leaf if ids is None else ids.nbytes
                    if size > 4 << 20:
                        yield _parts(row, doc, first, held)
                        first, held, size = first + len(held), [], 0
                yield _parts(row, doc, first, held)

    return lean(cut)


def _parts(row: pa.Array, doc: pa.Array, first: int, held: list) -> pa.RecordBatch:
    n = len(held)
    same = pa.array(np.zeros(n, np.int32))
    columns = [row.take(same), doc.take(same), pa.array(np.arange(first, first + n)), pa.array([h[0] for h in held], pa.int32()), pa.array([h[1] for h in held], pa.string()), pa.array([h[2] for h in held], pa.binary())]
    return pa.record_batch(columns, names=["row", "doc_id", "part", "state", "letters", "ids"])


PARTS = "row long, doc_id long, part long, state int, letters string, ids binary"


def leaf_batches(path: str):
    """The same rows, with the ids of every leaf instead of its letters."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = leaves_of(path)
        for batch in batches:
            state, letters, ids = (batch.column(k).to_pylist() for k in (3, 4, 5))
            ids = [i if s == 0 else of.encode(x, s == 2).astype("<u4").tobytes() for s, x, i in zip(state, letters, ids, strict=True)]
            yield pa.record_batch([*(batch.column(k) for k in range(4)), pa.nulls(len(ids), pa.string()), pa.array(ids, pa.binary())], names=batch.schema.names)

    return lean(encode)


def joined_batches(path: str):
    """Rows of parts, sorted by row and part, to (doc_id, ids)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = leaves_of(path)
        now, doc, done, leaves = None, None, [], []

        def whole() -> pa.RecordBatch:
            ids = np.concatenate([np.zeros(0, np.uint32), *done])
            return pa.record_batch([pa.array([doc], pa.int64()), ids_column(ids, np.array([len(ids)]))], names=["doc_id", "ids"])

        for batch in batches:
            for row, d, state, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 5)), strict=True):
                if row != now and now is not None:
                    yield whole()
                    done, leaves = [], []
                now, doc = row, d
                ids = np.frombuffer(ids, "<u4")
                if state == 0:
                    done.append(ids)
                    continue
                leaves.append(ids)
                if state == 2:
                    done.append(of.tree(leaves))
                    leaves = []
        if now is not None:
            yield whole()

    return lean(join)


def encode(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Token ids of whole texts of ``docs`` (doc_id, text): doc_id, ids (array of int), a row per row.

    As the tokenizers library gives them without added special tokens, truncation or padding; special tokens inside a text are
    found as it does by default.  Texts with an unsplit stretch of more than ``leaf`` bytes go the way of the tree.  A null or
    empty text has no ids.  Null doc_ids and repeated rows stay.  Other columns of docs are not read.  No rows give no rows.
    """
    prepare(docs.sparkSession)
    path = path or vocabulary_path()
    rows = texts_of(docs).withColumn("long", F.exists(F.split("text", SPACE), lambda w: F.octet_length(w) > leaf))
    short = rows.where("not long").select("doc_id", "text").mapInArrow(encoded_batches(path), "doc_id long, ids array<int>")
    long = rows.where("long").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = stored(long.mapInArrow(cut_batches(path, leaf), PARTS), "word-leaves")  # rows keep their numbers from here on
    ready = parts.where("state = 0").unionByName(parts.where("state > 0").repartition("row", "part").mapInArrow(leaf_batches(path), PARTS))
    joined = ready.repartition("row").sortWithinPartitions("row", "part").mapInArrow(joined_batches(path), "doc_id long, ids array<int>")
    return short.unionByName(joined)


@lru_cache(maxsize=1)
def spellings(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens by id, each with a space after it, and where they begin."""
    vocabulary = {i: t.encode() + b" " for t, i in tokenizer(path).get_vocab(with_added_tokens=True).items()}
    table = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
    return np.frombuffer(b"".join(table), np.uint8), np.r_[0, np.cumsum([len(t) for t in table])].astype(np.int64)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, text: str = "decoded") -> DataFrame:
    """df with a column more: the text that the vocabulary's own decoder gives for ``ids``, special tokens included.

    This vocabulary states no decoder, which means tokens as they are spelled, a space between any two.  Ids that it doesn't
    have are left out, as the library does.  Null ids give null, none the empty text.  If df has a column of the name, the new
    one gets underscores.
    """
    prepare(df.sparkSession)
    path = path or vocabulary_path()
    name = free(text, df.columns)
    at = df.columns.index(ids)
    schema = StructType([*df.schema, StructField(name, StringType())])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts = spellings(path)
        for batch in batches:
            column = batch.column(at)
            bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
            flat = column.values.to_numpy(zero_copy_only=False)
            for a, b in slices(bounds, 1 << 19):
                own = flat[bounds[a] : bounds[b]].astype(np.int64)
                known = (own >= 0) & (own < len(starts) - 1)
                own = np.where(known, own, 0)
                lengths = np.where(known, starts[own + 1] - starts[own], 0)
                ends = np.r_[0, np.cumsum(lengths)]
                raw = data[ranges(starts[own], lengths)]
                rows = ends[bounds[a : b + 1] - bounds[a]]
                keep = np.ones(len(raw), bool)
                full = rows[1:] > rows[:-1]
                keep[rows[1:][full] - 1] = False  # the space after a row's last token
                sizes = np.diff(rows) - full
                texts = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[keep]))).cast(pa.string())
                valid = column.slice(a, b - a).is_valid()
                texts = pc.if_else(valid, texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(batch.num_columns)), texts], names=[*batch.schema.names, name])

    return df.mapInArrow(lean(spelled), schema)

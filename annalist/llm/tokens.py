"""Token ids of whole texts, by the tokenizers library, one call for each distinct run of non-space bytes."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from annalist.llm.common import ranges

END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Distinct runs that a worker remembers before it starts anew.
REMEMBERED = 600_000

#: Classes of bytes: 0 ASCII white space, where the vocabulary's rules split and which they drop; 1 a-z; 2 ASCII signs
#: that always end a run of letters and start none (no apostrophe, no part of a special token); 3 all others.
KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[97:123] = 1
KIND[list(b'!"#$%&()*+,-./:;=?@[]^_`{}~')] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pieces of rows that the vocabulary's rules encode independently of their surroundings, and how many each row has.

    Rows are cut at ASCII white space and between letters and plain signs, after lower-casing A-Z.  Where a slice may
    hold a special token it is cut at white space alone, and its case stays.
    """
    n = len(offsets) - 1
    if not len(data):
        return pa.array([], pa.string()), np.zeros(n, np.int64)
    kind = None
    if b"<|" not in data.tobytes():
        data = LOWER[data]
        kind = KIND[data]
        inside = kind != 0
    else:
        inside = KIND[data] != 0
    head = np.empty_like(inside)
    head[0] = True
    head[1:] = ~inside[:-1]
    if kind is not None:
        both = kind[:-1] * kind[1:]
        head[1:] |= (both == 2)
    head[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(inside & head)
    kept = np.cumsum(inside, dtype=np.int32)
    at = np.empty(len(starts) + 1, np.int32)
    at[:-1] = kept[starts] - 1
    at[-1] = kept[-1]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[inside])))
    bounds = np.searchsorted(starts, offsets)
    return words, bounds[1:] - bounds[:-1]


class Encoder:
    """Ids of texts; remembers the ids of runs it has seen, within a bound."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = np.zeros(1024, np.int64)
        self.lengths = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, flat, and the number of each one's.  Words of letters alone are one piece each and share a call:
        the ids that end a piece tell them apart again."""
        if len(words) > 1:
            ids = np.asarray(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
            last = np.flatnonzero(self.final[ids])
            if len(last) == len(words):
                return ids, np.diff(last, prepend=-1)
        each = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter((i for ids in each for i in ids), np.uint32, int(lengths.sum())), lengths

    def learn(self, words: list[str]) -> None:
        plain, others = [], []
        for w in words:
            (plain if w.isalpha() else others).append(w)
        for k in range(0, len(plain), 2048):
            self.keep(plain[k : k + 2048], *self.encoded(plain[k : k + 2048]))
        if others:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
            lengths = np.fromiter(map(len, each), np.int64, len(each))
            self.keep(others, np.fromiter((i for ids in each for i in ids), np.uint32, int(lengths.sum())), lengths)

    def keep(self, words: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        first, need = len(self.known), self.used + len(flat)
        while len(self.starts) < first + len(words):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while len(self.flat) < need:
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.starts[first : first + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + len(words)] = lengths
        self.flat[self.used : need] = flat
        self.used = need
        self.known.update(zip(words, range(first, first + len(words)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after the other, and the number of each row's."""
        words, counts = runs(data, offsets)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > REMEMBERED:
            self.forget()
        get = self.known.get
        where = [get(w) for w in distinct]
        if None in where:
            self.learn([w for w, k in zip(distinct, where, strict=True) if k is None])
            where = [get(w) for w in distinct]
        where = np.asarray(where, np.int64)
        index = where[coded.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.zeros(0, np.int64)
        lengths = self.lengths[index]
        ids = self.flat[ranges(self.starts[index], lengths)]
        total = np.r_[0, np.cumsum(lengths)]
        bounds = np.r_[0, np.cumsum(counts)]
        return ids, total[bounds[1:]] - total[bounds[:-1]]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each row's ids."""
    longer = counts + 1
    out = np.empty(int(longer.sum()), np.uint32)
    last = np.cumsum(longer) - 1
    keep = np.ones(len(out), bool)
    keep[last] = False
    out[keep] = ids
    out[last] = end_id
    return out, longer

"""Words and word hashes of many texts at once, in numpy over their bytes."""

from __future__ import annotations

import numpy as np

from annalist.llm.common import mix

#: Letters between words: ASCII white space (0x20, 0x09-0x0D).
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Letters between words where punctuation doesn't count: all ASCII but letters and digits.
SIGNS = np.zeros(256, bool)
SIGNS[:128] = True
SIGNS[48:58] = SIGNS[65:91] = SIGNS[97:123] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240229)
#: A random number for each byte at each of 64 places; later places repeat them, multiplied.
TABLE = _random.integers(0, 1 << 63, 64 * 256, dtype=np.uint64) * np.uint64(2) + _random.integers(0, 2, 64 * 256, dtype=np.uint64)
ODD = _random.integers(0, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the rows' numbers of words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    inside = ~between[data]
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:]
    some = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][some], offsets[1:][some] - 1
    head[first] = inside[first]
    tail[last] = inside[last]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    at = np.searchsorted(starts, offsets)
    return starts, ends, at[1:] - at[:-1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words; ``data`` may be lower-cased first."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    heads = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64)
    place -= np.repeat(heads, lengths)
    at = place + np.repeat(starts, lengths)
    value = TABLE[((place & 63) << 8) | data[at]]
    if len(lengths) and int(lengths.max()) > 64:
        far = np.flatnonzero(place > 63)
        value[far] *= mix(np.uint64(0x9E3779B97F4A7C15) * (place[far] >> 6).astype(np.uint64)) | np.uint64(1)
    return mix(np.add.reduceat(value, heads) + lengths.astype(np.uint64))


def shingles(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each row (the whole row if it has fewer, none if it has none), in row order,
    and the rows' numbers of them."""
    ends = np.cumsum(counts)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.uint64), n
    firsts = np.repeat(ends - counts - (np.cumsum(n) - n), n) + np.arange(total)
    padded = np.r_[words, np.zeros(size, np.uint64)]
    out = np.zeros(total, np.uint64)
    for k in range(size):
        out += padded[firsts + k] * ODD[k]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        at = (np.cumsum(n) - n)[short]
        for row, a in zip(short, at, strict=True):
            own = words[ends[row] - counts[row] : ends[row]]
            out[a] = (own * ODD[: len(own)]).sum(dtype=np.uint64) ^ ODD[40 + len(own) % 20]
    return mix(out), n


def distinct_rows(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Each row's distinct hashes, ascending."""
    ends = np.cumsum(counts)
    out = []
    for e, n in zip(ends.tolist(), counts.tolist(), strict=True):
        own = np.sort(hashes[e - n : e])
        out.append(own[np.r_[True, own[1:] != own[:-1]]] if n else own)
    return out

"""Suffix arrays of many short texts in one buffer: Larsson-Sadakane refinement, Kasai common prefixes, binary search."""

from __future__ import annotations

import numpy as np

from annalist.llm.common import ranges

START = 8


class Shard:
    """The sorted suffixes of texts data[begin:begin + length]; a suffix ends with its text, and of two that are equal up to
    the end of one the text that comes first is smaller there (each text has an end letter of its own).

    ``order``: positions of all suffixes, ascending; ``before[p]``: the suffix before p in it, -1 for the first.
    """

    def __init__(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray):
        self.data, self.begins, self.lengths = data, begins, lengths
        n = len(data)
        self.end = np.zeros(n, np.int64)  # of the text of each position
        text = np.repeat(np.arange(len(begins)), lengths)
        at = ranges(begins, lengths)
        self.end[at] = (begins + lengths)[text]
        self._sort(at, text)
        self.before = np.full(n, -1, np.int64)
        self.before[self.order[1:]] = self.order[:-1]

    def _sort(self, at: np.ndarray, text: np.ndarray) -> None:
        n, texts = len(self.data), len(self.begins)
        # first ranks: START letters, as a number; a suffix that ends sooner is ordered by the end letter of its text
        padded = np.r_[self.data, np.zeros(START, np.uint8)]
        key = np.zeros(n, np.uint64)
        for k in range(START):
            key = (key << np.uint64(8)) | padded[k : k + n]
        room = self.end[at] - at
        key = key[at]
        short = room < START
        cut = np.minimum(room, START).astype(np.uint64) * np.uint64(8)
        mask = np.where(short, ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(cut, np.uint64(63))), np.uint64(0xFFFFFFFFFFFFFFFF))
        key &= mask
        order = np.argsort(key)
        fresh = np.ones(len(order), bool)
        fresh[1:] = key[order][1:] != key[order][:-1]
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        if short.any():  # among equal numbers: suffixes that ended come first, by where they ended and whose end it is
            mixed = np.zeros(len(order), bool)
            mixed[head[short[order]]] = True
            some = np.flatnonzero(mixed[head])
            tie = np.where(short, room * texts + text, (START + 1) * texts)[order[some]]
            both = (head[some] << np.int64(32)) | tie
            new = np.argsort(both, kind="stable")
            order[some], both = order[some][new], both[new]
            fresh[some] = np.r_[True, both[1:] != both[:-1]]
            head[some] = np.maximum.accumulate(np.where(fresh[some], some, 0))
        order = at[order]
        rank = np.zeros(n + 1, np.int64)
        rank[order] = head
        owner = np.zeros(n, np.int64)
        owner[at] = text
        step = START
        while True:
            # only groups of several suffixes are sorted again, by the rank of what follows
            several = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))
            if not len(several):
                break
            p = order[several]
            after = p + step
            ended = after >= self.end[p]
            second = np.where(ended, owner[p], texts + rank[np.minimum(after, n)])
            both = (rank[p] << np.int64(32)) | second
            new = np.argsort(both, kind="stable")
            p, both = p[new], both[new]
            order[several] = p
            fresh[several] = np.r_[True, both[1:] != both[:-1]]
            head = np.maximum.accumulate(np.where(fresh[several], several, 0))
            rank[p] = head
            step *= 2
        self.order = order

    def prefixes(self, wanted: np.ndarray) -> np.ndarray:
        """Kasai: letters that each suffix shares with the one before it, for the first wanted[t] suffixes of text t.

        Going along a text the number falls by one at most, so what is known of one suffix is not read again for the next.
        All texts go along at once.
        """
        out = np.zeros(len(self.data), np.int64)
        lane = np.flatnonzero(wanted > 0)
        at, stop = self.begins[lane].copy(), (self.begins + wanted)[lane]
        known = np.zeros(len(lane), np.int64)
        data = np.r_[self.data, np.uint8(0)]
        while len(at):
            before = self.before[at]
            x, y = at + known, before + known
            same = (before >= 0) & (x < self.end[at]) & (y < self.end[before]) & (data[np.minimum(x, len(data) - 1)] == data[np.minimum(y, len(data) - 1)])
            known += same
            done = ~same
            out[at[done]] = known[done]
            at[done] += 1
            known[done] = np.maximum(known[done] - 1, 0)
            live = at < stop
            if not live.all():
                at, stop, known = at[live], stop[live], known[live]
        return out


def repeated_in(shard: Shard, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Whether each of the first wanted[t] positions of text t starts a string of ``depth`` letters that starts elsewhere too."""
    shared = shard.prefixes(wanted)
    long = np.flatnonzero(shared >= depth)
    out = np.zeros(len(shard.data), bool)
    out[long] = True
    out[shard.before[long]] = True
    return out


def compare(data: np.ndarray, x: np.ndarray, y: np.ndarray, depth: int) -> np.ndarray:
    """-1, 0, 1: data[x:x + depth] against data[y:y + depth] for every pair."""
    out = np.zeros(len(x), np.int8)
    live = np.arange(len(x))
    for k in range(depth):
        a, b = data[x[live] + k], data[y[live] + k]
        different = a != b
        if different.any():
            out[live[different]] = np.where(a[different] < b[different], -1, 1)
            live = live[~different]
            if not len(live):
                break
    return out


def search(data: np.ndarray, ordered: np.ndarray, keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each string at ``keys`` belongs among the ascending ones at ``ordered``, and whether it is there."""
    low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(ordered), np.int64)
    found = np.zeros(len(keys), bool)
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low, found
        middle = (low[live] + high[live]) // 2
        c = compare(data, keys[live], ordered[middle], depth)
        found[live[c == 0]] = True
        high[live[c <= 0]] = middle[c <= 0]
        low[live[c > 0]] = middle[c > 0] + 1


def repeated(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray, group: np.ndarray, depth: int, shard_bytes: int = 1 << 20) -> np.ndarray:
    """Whether the string of ``depth`` letters that starts at each position also starts elsewhere.

    Texts of a group lie together; equal strings are only found for sure if they are in texts of one group.  They are sorted in shards of about ``shard_bytes``; a group in several shards is merged:
    each shard's strings are looked up among those of the shards before it by binary search, and put in their places.
    """
    out = np.zeros(len(data), bool)
    if not len(begins):
        return out
    wanted = np.maximum(lengths - depth + 1, 0)
    shards = (begins - begins[0]) // shard_bytes
    heads = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]])
    split = set(group[heads[1:]][group[heads[1:]] == group[heads[1:] - 1]].tolist())
    merged: dict[int, np.ndarray] = {}
    for a, b in zip(heads, np.r_[heads[1:], len(begins)], strict=True):
        base, stop = begins[a], begins[b - 1] + lengths[b - 1]
        shard = Shard(data[base:stop], begins[a:b] - base, lengths[a:b])
        out[base:stop] |= repeated_in(shard, wanted[a:b], depth)
        for g in dict.fromkeys(group[[a, b - 1]].tolist()):
            if g not in split:
                merged.pop(g, None)
                continue
            own = np.flatnonzero(group[a:b] == g)
            inside = np.zeros(stop - base, bool)
            inside[ranges(begins[a:b][own] - base, wanted[a:b][own])] = True
            mine = shard.order[inside[shard.order]] + base
            if g not in merged:
                merged = {g: mine}  # groups come one after the other
                continue
            others = merged[g]
            place, there = search(data, others, mine, depth)
            out[mine[there]] = True
            # all equal strings among the others are repeated too: they follow the place found
            at = place[there]
            while len(at):
                out[others[at]] = True
                at = np.unique(at + 1)
                at = at[at < len(others)]
                at = at[compare(data, others[at - 1], others[at], depth) == 0]
            merged[g] = np.insert(others, place[~there], mine[~there])
    return out

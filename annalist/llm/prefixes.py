"""Exact token counts of every prefix of a text, by dynamic programming over the vocabulary's merges.

A byte-pair encoding is the only sequence of tokens in which every two neighbours would stay apart if they were encoded
alone.  So the last token of each prefix's encoding follows from the last tokens of shorter prefixes, and the counts of all
prefixes of a piece come from one pass over it.  Truncation and budgets are then lookups.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from annalist.llm.common import gathered, lean, prepare, ranges, slices, text_bytes, texts_of
from annalist.llm.tokens import KIND, runs, vocabulary_path

#: Distinct pieces that a worker remembers; beyond it the half used least goes.
REMEMBERED = 700_000
END = "</w>"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


class State:
    """What is known of the prefixes of a word: last token and number of tokens inside a word (up to ``inner``), and number
    of tokens if the word ended there (0: not known)."""

    def __init__(self) -> None:
        self.word, self.last, self.count, self.ended, self.inner = "", [0], [0], [0], 0


class Merges:
    """Which tokens may stand side by side, from a vocabulary file of byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault(x << 20 | y, r)
            self.parts.setdefault(z, (x, y, r))
        special = [t["content"] for t in spec["added_tokens"]]
        self.specials = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else regex.compile("(?!)()")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.apart: dict[int, bool] = {}
        #: letters of bytes that go on a character, and how long tokens are at most, by their last two letters
        self.more = frozenset(self.letters[0x80:0xC0])
        self.reach, self.reach_end = {}, {}
        for t in self.vocab:
            reach, t = (self.reach_end, t[: -len(END)]) if t.endswith(END) else (self.reach, t)
            reach[t[-2:]] = max(reach.get(t[-2:], 1), len(t))
        self.longest = max(*self.reach.values(), *self.reach_end.values())

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the tokens a, b, encoded as one word, come out as a, b: undo their merges from the latest to the
        earliest and see whether the parts that touch would have merged before."""
        key = a << 20 | b
        known = self.apart.get(key)
        if known is None:
            limit = 1 << 30
            known = True
            while True:
                r = self.rank.get(a << 20 | b)
                if r is not None and r < limit:
                    known = False
                    break
                pa_, pb = self.parts.get(a), self.parts.get(b)
                if pa_ is None and pb is None:
                    break
                # of equal merges the left one comes first, so the right one is undone first and loses ties
                if pa_ is None or pb is not None and pb[2] >= pa_[2]:
                    limit, b = pb[2] + 1, pb[0]
                else:
                    limit, a = pa_[2], pa_[1]
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            self.apart[key] = known
        return known

    def piece(self, s: str, state: State | None = None) -> list[int]:
        """Token counts of the words s[:e] for every e that ends a letter of the text; s in byte letters.

        ``state`` keeps what is known of the prefixes of the word before: sorted words begin alike.
        """
        state = state or State()
        last, count, ended, inner = state.last, state.count, state.ended, state.inner
        n, c, before = len(s), 0, state.word
        for x, y in zip(s, before, strict=False):
            if x != y:
                break
            c += 1
        state.word = s
        del ended[c + 1 :]
        if inner > c:
            inner = c
        while len(last) <= n:
            last.append(0)
            count.append(0)
        get, known, reach, reach_end, more = self.vocab.get, self.apart.get, self.reach.get, self.reach_end.get, self.more
        out = []
        for i in range(1, n + 1):
            if inner < i < n:
                for j in range(max(0, i - reach(s[i - 2 : i], 1) if i > 1 else 0), i):
                    t = get(s[j:i])
                    if t is not None:
                        if j == 0:
                            last[i], count[i] = t, 1
                            break
                        apart = known(last[j] << 20 | t)
                        if apart or apart is None and self.stay_apart(last[j], t):
                            last[i], count[i] = t, count[j] + 1
                            break
                inner = i
            if i >= len(ended):
                ended.append(0)
            if i == n or s[i] not in more:
                k = ended[i]
                if not k:
                    for j in range(max(0, i - reach_end(s[i - 2 : i], 1) if i > 1 else 0), i):
                        t = get(s[j:i] + END)
                        if t is not None:
                            if j == 0:
                                k = 1
                                break
                            apart = known(last[j] << 20 | t)
                            if apart or apart is None and self.stay_apart(last[j], t):
                                k = count[j] + 1
                                break
                    ended[i] = k
                out.append(k)
        state.inner = inner
        return out

    def pieces(self, s: str) -> list[int]:
        """Counts of all prefixes of a normalized string without white space or special tokens."""
        out, base, letters = [], 0, self.letters
        for m in self.pattern.finditer(s):
            p = m.group()
            if p[0] == "'" and len(p) > 1 and p[1].isalpha():  # a contraction is only one once it is whole
                own = [*(self.pieces(p[:k])[-1] for k in range(1, len(p))), self.piece(p)[-1]]
            else:
                own = self.piece("".join([letters[b] for b in p.encode()]))
            out += [base + c for c in own]
            base += own[-1]
        return out

    def whole(self, s: str) -> int:
        """Tokens of any string, special tokens and white space included."""
        total = 0
        for k, part in enumerate(self.specials.split(s)):
            if k % 2:
                total += 1
                continue
            for m in self.pattern.finditer(lower(unicodedata.normalize("NFC", part))):
                total += self.piece("".join([self.letters[b] for b in m.group().encode()]))[-1]
        return total

    def prefixes(self, s: str) -> list[int]:
        """Counts of all prefixes of a run without ASCII white space."""
        out, base, at, known = [], 0, 0, {}
        for m in self.specials.finditer(s) if "<|" in s else ():  # up to its last letter a special token is ordinary text
            text = s[at : m.end() - 1]
            before = known.get(text) or self.plain(text)
            if len(text) < 64 and len(known) < 1000:
                known[text] = before
            out += [base + c for c in before]
            base += (before[m.start() - at - 1] if m.start() > at else 0) + 1
            out.append(base)
            at = m.end()
        return out + [base + c for c in self.plain(s[at:])] if at else self.plain(s)

    def plain(self, s: str) -> list[int]:
        """Counts of all prefixes of a string without special tokens."""
        if s.isascii():
            return self.pieces(s.lower())
        out, base = [], 0
        for k, part in enumerate(regex.split(r"(\s+)", s)):
            own = [0] * len(part) if k % 2 or not part else self.normalized(part)
            out += [base + c for c in own]
            base += own[-1] if own else 0
        return out

    def normalized(self, s: str) -> list[int]:
        """Counts of all prefixes of a string without white space that may not be in normal form: letter by letter where a
        later one may change an earlier one, at once in between; only the last pieces are read again."""
        if unicodedata.is_normalized("NFC", s) and len(low := lower(s)) == len(s):
            return self.pieces(low)
        first = [begins(c, s[k - 1] if k else "") for k, c in enumerate(s)] + [True]
        regular = [first[k] and first[k + 1] and len(c.lower()) == 1 for k, c in enumerate(s)]
        out, reader, k = [], Reader(self), 0
        while k < len(s):
            e = k + 1
            if regular[k]:
                out.append(reader.add(lower(s[k])))
            else:
                while not first[e]:
                    e += 1
                # letters of a cluster may still become one or change places: most steps only add to what was read before
                mark, raw, now = reader.mark(), "", ""
                for x in range(k, e):
                    c = s[x]
                    if len(raw) > 1 and unicodedata.combining(c) and unicodedata.combining(c) == unicodedata.combining(raw[-1]):
                        raw, then = raw + c, now + lower(c)  # a mark of the same class as the last: blocked, and in its place
                    else:
                        raw = unicodedata.normalize("NFC", s[k : x + 1])
                        then = lower(raw)
                    if not then.startswith(now):
                        reader.back(mark)
                        now = ""
                    out.append(reader.add(then[len(now) :]))
                    now = then
            k = e
        return out


class Reader:
    """Token counts of a string without white space that grows at its end, or might: each letter is read once."""

    #: Letters from which on the last piece can no longer become part of a contraction.
    SETTLED = 4

    def __init__(self, merges: Merges):
        self.merges, self.base, self.tail = merges, 0, ""
        #: an open piece: its class (of letters, or of signs), its last letters, and what State has of its prefixes
        self.kind, self.recent, self.last, self.count = None, "", [0], [0]

    @staticmethod
    def kind_of(c: str) -> str | None:
        return "letter" if c.isalpha() and unicodedata.category(c)[0] == "L" else None if unicodedata.category(c)[0] == "N" else "sign"

    def _push(self, c: str) -> None:
        m = self.merges
        for b in c.encode():
            letter = m.letters[b]
            self.recent = (self.recent + letter)[-m.longest :]
            n = len(self.last)
            r = self.recent
            for j in range(max(0, n - len(r), n - m.reach.get(r[-2:], 1) if n > 1 else 0), n):
                t = m.vocab.get(r[len(r) - (n - j) :])
                if t is not None and (j == 0 or m.stay_apart(self.last[j], t)):
                    self.last.append(t)
                    self.count.append(self.count[j] + 1)
                    break
            else:
                raise ValueError("a letter without a token")

    def _ended(self) -> int:
        """Tokens of the open piece if it ends here."""
        m, n, r = self.merges, len(self.last) - 1, self.recent
        for j in range(max(0, n - len(r), n - m.reach_end.get(r[-2:], 1) if n > 1 else 0), n):
            t = m.vocab.get(r[len(r) - (n - j) :] + END)
            if t is not None and (j == 0 or m.stay_apart(self.last[j], t)):
                return self.count[j] + 1
        return 0

    def add(self, text: str) -> int:
        """Appends a text; the count of all."""
        for c in text:
            kind = self.kind_of(c)
            if self.kind is not None:
                if kind == self.kind:
                    self._push(c)
                    continue
                self.base += self._ended()
                self.kind, self.recent, self.last, self.count, self.tail = None, "", [0], [0], ""
            self.tail += c
            found = [m.start() for m in self.merges.pattern.finditer(self.tail)]
            if not found:
                continue
            begun = found[-1]
            if kind is not None and len(self.tail) - begun >= self.SETTLED and self.tail[begun : begun + 1] != "'":
                self.base += self._read(self.tail[:begun])
                self.kind, rest, self.tail = kind, self.tail[begun:], ""
                for x in rest:
                    self._push(x)
            elif len(found) > 4:
                cut = found[-4]
                self.base += self._read(self.tail[:cut])
                self.tail = self.tail[cut:]
        return self.base + (self._ended() if self.kind is not None else self._read(self.tail))

    def _read(self, text: str) -> int:
        counts = self.merges.pieces(text)
        return counts[-1] if counts else 0

    def mark(self) -> tuple:
        """A place to come back to."""
        return self.base, self.tail, self.kind, self.recent, self.last, self.count, len(self.last)

    def back(self, mark: tuple) -> None:
        self.base, self.tail, self.kind, self.recent, self.last, self.count, n = mark
        del self.last[n:], self.count[n:]


def begins(c: str, before: str = "") -> bool:
    """Whether a letter never joins the one before it, and stays as it is in normal form."""
    o, p = ord(c), ord(before or "a")
    if 0x1160 <= o <= 0x11A7:  # a vowel of Hangul joins a leading consonant, a trailing consonant a vowel
        return not 0x1100 <= p <= 0x115F
    if 0x11A8 <= o <= 0x11FF:
        return not (0x1160 <= p <= 0x11A7 or 0xAC00 <= p <= 0xD7A3)
    return o < 0x300 or (unicodedata.combining(c) == 0 and unicodedata.category(c)[0] not in "MC" and unicodedata.is_normalized("NFC", c))


def lower(s: str) -> str:
    return s.lower() if "Σ" not in s else "".join(map(str.lower, s))


@lru_cache(maxsize=1)
def merges(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Counts at every prefix of whole texts; remembers the pieces it has seen, within a bound."""

    def __init__(self, path: str):
        self.merges = merges(path)
        self.known: dict[str, int] = {}
        self.words: list[str] = []
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths, self.hits = (np.zeros(1 << 12, np.int64) for _ in range(3))

    def forget(self) -> None:
        n = len(self.words)
        keep = np.sort(np.argsort(self.hits[:n], kind="stable")[n // 2 :])
        lengths = self.lengths[keep]
        flat = self.flat[ranges(self.starts[keep], lengths)]
        self.words = [self.words[k] for k in keep]
        self.known = {w: k for k, w in enumerate(self.words)}
        self.starts[: len(keep)], self.lengths[: len(keep)] = np.cumsum(lengths) - lengths, lengths
        self.hits[: len(keep)], self.hits[len(keep) :] = self.hits[keep] // 2, 0
        self.flat[: len(flat)], self.used = flat, len(flat)

    def learn(self, words: list[str]) -> None:
        words.sort()
        state, found, letters = State(), [], self.merges.letters
        for w in words:
            if w.isalpha() and "Σ" not in w:
                if w.isascii():
                    found.append(self.merges.piece(w.lower(), state))
                    continue
                if len(low := w.lower()) == len(w) and unicodedata.is_normalized("NFC", w) and unicodedata.is_normalized("NFC", low):
                    found.append(self.merges.piece("".join([letters[b] for b in low.encode()]), state))
                    continue
            found.append(self.merges.prefixes(w))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        need, first = self.used + int(lengths.sum()), len(self.words)
        while len(self.flat) < need:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.starts) < first + len(words):
            self.starts, self.lengths, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.hits))
        self.flat[self.used : need] = np.fromiter((c for f in found for c in f), np.int32, need - self.used)
        self.starts[first : first + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + len(words)] = lengths
        self.used = need
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.words += words

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counts of all non-empty prefixes (by code point) of every row, and the rows' numbers of code points."""
        heads = (data & 0xC0) != 0x80
        chars = np.r_[0, np.cumsum(heads)][offsets]
        words, per_row = runs(data, offsets)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > REMEMBERED and len(self.known) > len(distinct):
            self.forget()
        get = self.known.get
        where = [get(w) for w in distinct]
        if None in where:
            self.learn([w for w, k in zip(distinct, where, strict=True) if k is None])
            where = [get(w) for w in distinct]
        out = np.zeros(int(chars[-1]), np.int32)
        if distinct:
            index = np.asarray(where, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
            self.hits += np.bincount(index, minlength=len(self.hits))
            lengths = self.lengths[index]
            stops = self.starts[index] + lengths - 1
            totals = self.flat[stops].astype(np.int64)
            before = np.cumsum(totals) - totals
            first = np.r_[0, np.cumsum(per_row)][:-1]
            base = np.zeros(len(per_row), np.int64)
            some = per_row > 0
            base[some] = before[first[some]]
            before -= np.repeat(base, per_row)
            inside = np.flatnonzero(KIND[data[heads]] != 0)
            out[inside] = self.flat[ranges(self.starts[index], lengths)] + np.repeat(before, lengths).astype(np.int32)
            # a white space letter adds nothing: it has the count of the last letter before it in its row
            at = np.full(len(out), -1, np.int64)
            at[inside] = inside
            rows = chars[:-1][chars[:-1] < chars[1:]]
            at[rows] = np.where(at[rows] < 0, len(out), at[rows])
            carried = _carry(at)
            out = np.r_[out, np.int32(0)][carried]
        return out, np.diff(chars)


def _carry(at: np.ndarray) -> np.ndarray:
    """Each -1 takes the nearest value before it."""
    known = np.flatnonzero(at >= 0)
    return at[np.repeat(known, np.diff(np.r_[known, len(at)]))]


def prefix_counts(docs: DataFrame, path: str | None = None, limit: int = 2048, store: bool = True) -> DataFrame:
    """Token counts of ``docs`` (doc_id, text), one row per document row.

    Columns: doc_id; n_bytes (UTF-8); n_chars; n_tokens (of the whole text); over_limit (n_tokens > limit);
    chars_within_limit (code points of the longest prefix of at most ``limit`` tokens); and, if ``store``, ``steps``: for
    every code point how much the prefix that ends there has more tokens than the one before it, as int8 (int32 if a step
    is larger; then there are four bytes to a code point).  Running sums of ``steps`` are the counts of all prefixes.
    A null or empty text has 0 everywhere.  Repeated rows stay.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    path = path or vocabulary_path()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in gathered(batches):
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets, 8 << 20):
                counts, chars = counter.counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.cumsum(chars)
                tokens = np.where(chars > 0, np.r_[counts, 0][ends - 1], 0).astype(np.int64)
                within = chars.copy()
                for k in np.flatnonzero(tokens > limit):
                    own = counts[ends[k] - chars[k] : ends[k]]
                    fit = np.flatnonzero(own <= limit)
                    within[k] = int(fit[-1]) + 1 if len(fit) else 0
                columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(chars), pa.array(tokens), pa.array(tokens > limit), pa.array(within)]
                if store:
                    columns.append(pa.array([steps(counts[e - n : e]) for e, n in zip(ends, chars, strict=True)], pa.binary()))
                yield pa.record_batch(columns, names=names)

    schema = "doc_id long, n_bytes long, n_chars long, n_tokens long, over_limit boolean, chars_within_limit long" + ", steps binary" * store
    names = [c.split()[0] for c in schema.split(", ")]
    return texts_of(docs).mapInArrow(lean(counted), schema)


def steps(counts: np.ndarray) -> bytes:
    d = np.diff(counts, prepend=0)
    return d.astype(np.int8).tobytes() if not len(d) or (d.min() >= -128 and d.max() <= 127) else d.astype("<i4").tobytes()


def counts_of(blob: bytes, n_chars: int) -> np.ndarray:
    """Counts of all non-empty prefixes from ``steps``."""
    return np.cumsum(np.frombuffer(blob, np.int8 if len(blob) == n_chars else "<i4"), dtype=np.int64)

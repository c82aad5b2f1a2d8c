"""The operators against brute force, round trips, held-out labels, and awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annalist.llm import decontam, html, huffman, jaccard, lines, packing, prefixes, repeats, suffixes, tokens, topk, toxicity
from annalist.llm.common import text_bytes
from annalist.llm.components import components
from annalist.llm.decontam import SHORT_MASKS, best_stretch, decontaminated, overlaps

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "s1", 0),
    (3, "one", "en", "s1", 3),
    (4, "one", "en", "s2", 3),
    (4, "one", "en", "s2", 3),
    (5, "Ünï <|endoftext|> code\x1c 'RE it's\n\n a ß İ", "de", None, 9),
    (6, "word " * 5000, "en", "s3", 25000),
    (7, "x" * 9000, "en", "s4", 9000),
]


def docs_of(spark, rows):
    # clashing extra columns must not matter
    return spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit("r"), "pos": F.lit(1), "line": F.lit("l"), "a": F.lit(0), "b": F.lit(0), "component": F.lit(0)})


def words_text(r, n):
    return " ".join("".join(r.choice("the er on ti na lo ma re".split()) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def sample(spark):
    """Texts with copies, near copies, shared passages and awkward rows."""
    r = random.Random(5)
    base = [words_text(r, r.randint(20, 160)) for _ in range(40)]
    passage = words_text(r, 70)
    rows = [t for t in base]
    for t in base[:12]:
        w = t.split()
        for _ in range(r.randint(1, 4)):
            x = list(w)
            for _ in range(r.randint(0, max(1, len(w) // 60))):
                x[r.randrange(len(x))] = words_text(r, 1)
            rows.append(" ".join(x))
    rows += [f"{words_text(r, 30)} {passage}. {words_text(r, 30)}" for _ in range(6)]
    return [(100 + k, t, "en", f"s{k % 7}", len(t)) for k, t in enumerate(rows)] + AWKWARD


def encode(text):
    return tokens.tokenizer(tokens.vocabulary_path()).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library():
    r = random.Random(1)
    letters = ["a", "B", "é", "É", "'", "s", "re", " ", "\n", "<|", "<|endoftext|>", "1", ",", ".", "_", "́", " ", "İ", "ß", "Σ", "—", "世", "\x1c", "$"]
    encoder, counter = tokens.Encoder(tokens.vocabulary_path()), prefixes.Counter(tokens.vocabulary_path())
    for _ in range(150):
        texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 12))) for _ in range(3)]
        data, offsets = text_bytes(pa.array(texts))
        ids, counts = encoder.encode(data, offsets)
        want = [encode(t) for t in texts]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
        got, n = counter.counts(data, offsets)
        assert n.tolist() == list(map(len, texts))
        assert got.tolist() == [len(encode(t[: k + 1])) for t in texts for k in range(len(t))]


def test_prefix_counts(spark, sample):
    out = prefixes.prefix_counts(docs_of(spark, sample), limit=40).collect()
    texts = Counter((d, t or "") for d, t, *_ in sample)
    assert len(out) == len(sample)
    by = {r["doc_id"]: r for r in out}
    for d, t in texts:
        r = by[d]
        counts = prefixes.counts_of(r["steps"], r["n_chars"]) if r["n_chars"] else np.zeros(0)
        assert (r["n_bytes"], r["n_chars"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), len(t), len(encode(t)), len(encode(t)) > 40)
        assert len(counts) == len(t) and (not len(t) or counts[-1] == r["n_tokens"])
        fit = [k + 1 for k, c in enumerate(counts) if c <= 40]
        assert r["chars_within_limit"] == (fit[-1] if fit else 0)
    assert prefixes.prefix_counts(docs_of(spark, [])).count() == 0


def test_code_lengths_are_limited_and_complete():
    for counts, limit in (([1], 3), ([1, 1], 3), ([2**k for k in range(12)], 5), (list(range(1, 300)), 10)):
        lengths = huffman.code_lengths(np.array(counts), limit)
        assert lengths.max() <= limit and (len(counts) == 1 or sum(2.0 ** -int(b) for b in lengths) == 1)
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def test_huffman_round_trip(spark, sample):
    out = {(r["doc_id"], r["start"]): r for r in huffman.token_ids(docs_of(spark, sample)).collect()}
    want, start = [], 0
    for d, t, *_ in sorted(sample, key=lambda r: r[0]):
        ids = [*encode(t), 2]
        want.append((d, start, ids))
        start += len(ids)
    assert len(out) == len(want)
    for d, s, ids in want:
        r = out[d, s]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
    assert huffman.token_ids(docs_of(spark, [])).count() == 0


def test_huffman_blocks(spark, sample, tmp_path):
    """Blocks of few ids: whole documents, each decoded on its own."""
    huffman.write_ids(docs_of(spark, sample), str(tmp_path / "ids"), size_of_block=300)
    blocks = spark.read.parquet(str(tmp_path / "ids" / "blocks"))
    assert blocks.count() > 20
    got = sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in huffman.read_ids(spark, str(tmp_path / "ids")).collect())
    assert got == sorted((d, [*encode(t), 2]) for d, t, *_ in sample)


def test_packing(spark, sample):
    out = packing.pack(docs_of(spark, sample).repartition(3), window=256, open_windows=4).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0
    assert sum(sum(n for _, n in s) != 256 for s in sequences.values()) <= 8
    for d, t, *_ in sample:
        if d == 4:
            continue  # twice in the sample
        ids, at = np.array([*encode(t), 2], np.uint32), 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_suffix_order_prefixes_and_merge():
    r = random.Random(3)
    for _ in range(60):
        depth, letters = r.choice([3, 5, 9, 17]), r.choice([b"ab", b"abc", b"a", bytes(range(4))])
        texts = [bytes(r.choice(letters) for _ in range(r.randint(1, 50))) for _ in range(r.randint(1, 10))]
        texts += [r.choice(texts) for _ in range(2)]
        lengths = np.array([len(t) for t in texts])
        begins, data = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(texts), np.uint8)
        shard, owner = suffixes.Shard(data, begins, lengths), np.repeat(np.arange(len(texts)), lengths)
        full = {p: [(1, int(x)) for x in data[p : shard.end[p]]] + [(0, int(owner[p]))] for p in range(len(data))}
        order = shard.order.tolist()
        assert order == sorted(full, key=full.get)
        shared = shard.prefixes(lengths)
        for a, b in zip(order, order[1:]):
            n = next(k for k, (x, y) in enumerate(zip(full[a], full[b])) if x != y)
            assert shared[b] == n
        counts = Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
        want = [i + depth <= len(t) and counts[t[i : i + depth]] > 1 for t in texts for i in range(len(t))]
        for size in (10, 40, 1000):
            assert suffixes.repeated(data, begins, lengths, np.zeros(len(texts), int), depth, size).tolist() == want


@pytest.mark.parametrize("depth,most", [(60, repeats.MOST), (200, repeats.MOST), (60, 2), (200, 0)])
def test_repeats(spark, sample, depth, most):
    """With few stretches to an anchor in a task, the others are split by what surrounds it."""
    out = repeats.remove_repeats(docs_of(spark, sample), depth, most).collect()
    texts = [(d, (t or "").encode()) for d, t, *_ in sample]
    counts = Counter(t[i : i + depth] for _, t in texts for i in range(len(t) - depth + 1))
    want = {}
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - depth + 1):
            if counts[t[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        want[d] = (len(t), bytes(c for c, g in zip(t, gone) if not g), len(re.findall(b"\1+", bytes(gone))))
    assert len(out) == len(texts)
    for r in out:
        assert (r["n_bytes"], bytes(r["kept"]), len(r["spans"])) == want[r["doc_id"]]
    assert repeats.remove_repeats(docs_of(spark, [])).count() == 0


def brute_components(rows, size, num, den):
    sets = {}
    for d, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[d] = {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            same = len(sets[a] & sets[b])
            if same and den * same >= num * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_signatures_of_similar_sets_meet():
    r = random.Random(9)
    for _ in range(300):
        n = r.randint(6, 150)
        x = {r.getrandbits(63) for _ in range(n)}
        k = r.randint(0, max(1, n // 5))
        y = set(r.sample(sorted(x), n - k // 2)) | {r.getrandbits(63) for _ in range(k - k // 2)}
        if x == y or 100 * len(x & y) < 80 * len(x | y):
            continue
        common = np.sort(np.array(r.sample(sorted(x), r.choice([0, n // 3, n])), np.uint64))
        both = np.array([*sorted(x), *sorted(y)], np.uint64)
        sig, of = jaccard.signatures(both, np.array([len(x), len(y)]), ~jaccard.member_of(both, common), 80, 100)
        assert set(sig[of == 0]) & set(sig[of == 1])


@pytest.mark.parametrize("size,num", [(4, 85), (5, 80)])
def test_near_duplicates(spark, sample, size, num):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs_of(spark, sample), size, num, 100).collect()}
    assert got == brute_components([(d, t) for d, t, *_ in sample], size, num, 100)
    assert jaccard.near_duplicates(docs_of(spark, [])).count() == 0


def test_near_duplicates_of_one_large_borderline_group(spark):
    """Copies of one text with so many changes that only some link: no link may be lost, whatever is compared with what."""
    r = random.Random(11)
    base = words_text(r, 110).split()
    rows = []
    for d in range(160):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = words_text(r, 1) + str(r.randrange(40))
        rows.append((d, " ".join(w), "en", "s", 1))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_duplicates(docs_of(spark, rows), 4, 85, 100).collect()}
    assert got == brute_components([(d, t) for d, t, *_ in rows], 4, 85, 100)
    # groups passed on in part, compared in blocks after the prefix filter
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_duplicates(docs_of(spark, rows), 4, 85, 100, collapse=2, block=8).collect()}
    assert got == brute_components([(d, t) for d, t, *_ in rows], 4, 85, 100)


@pytest.mark.parametrize("at_once", [1000, 0])
def test_components(spark, at_once):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (4, 4), (3, 1), (20, 3), (None, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), at_once).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7}
    assert components(spark.createDataFrame([], "a long, b long"), at_once).count() == 0


def test_lines(spark):
    rows = [(100 + k, f"own {k}\nboiler plate\n\nlast {k}", "en", f"s{k % 12}", 1) for k in range(30)] + [(150 + k, "few sites", "en", f"s{k % 9}", 1) for k in range(20)] + AWKWARD
    out = {r["doc_id"]: r for r in lines.dedup_lines(docs_of(spark, rows)).collect()}
    assert out[100]["text"] == rows[0][1] and out[100]["n_removed"] == 0
    assert out[107]["text"] == "own 7\n\nlast 7" and (out[107]["n_lines"], out[107]["n_removed"]) == (4, 1)
    assert out[155]["text"] == "few sites"
    assert (out[1]["text"], out[1]["n_lines"], out[2]["text"], out[2]["n_lines"]) == (None, 0, "", 1)
    assert lines.dedup_lines(docs_of(spark, [])).count() == 0


def test_decontamination(spark):
    r = random.Random(2)
    items = [(k, words_text(r, 40)) for k in range(6)] + [(50, words_text(r, 7)), (51, "too short"), (52, None), (53, "")]
    rows, want = [], set()
    for k, t in items[:6]:
        w = t.split()
        w[5], w[20], w[33] = "changed", "here", "too"
        rows += [(100 + 10 * k, f"{words_text(r, 50)} {t.upper()} {words_text(r, 9)}", "en", "s", 1), (101 + 10 * k, " ".join(w), "en", "s", 1), (102 + 10 * k, words_text(r, 200), "en", "s", 1)]
        want |= {(100 + 10 * k, k), (101 + 10 * k, k)}
    rows.append((990, f"so {items[6][1]} it is", "en", "s", 1))
    want.add((990, 50))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, rows + AWKWARD)
    assert {(x["doc_id"], x["item_id"]) for x in overlaps(docs, bench).collect()} == want
    kept = decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.collect()} == {x[0] for x in rows + AWKWARD} - {d for d, _ in want}
    assert overlaps(docs, bench.limit(0)).count() == 0 and overlaps(docs.limit(0), bench).count() == 0


def longest(equal):
    """By trying every stretch: the first of the longest ones that are an overlap; of fewer than 13 words only all of them."""
    n = len(equal)
    least = min(13, n)
    ways = [(b - a, -a) for a in range(n) for b in range(a + least, n + 1) if 4 * sum(equal[a:b]) >= 3 * (b - a)]
    size, start = max(ways, default=(0, 0))
    return (-start, -start + size, int(sum(equal[-start : -start + size]))) if size else None


def test_longest_stretch_by_trying_all():
    r = random.Random(4)
    for _ in range(400):
        equal = np.array([r.random() < r.choice([0.6, 0.75, 0.9]) for _ in range(r.randint(13, 45))])
        start, end, same = best_stretch(equal)
        assert (end - start >= 13) == (longest(equal) is not None)
        assert end - start < 13 or (start, end, same) == longest(equal)


def test_every_overlap_has_a_seed():
    """Whole short items one by one, with unequal words at any places; of 13 to 57 words, the fewest unequal ones of any text
    without a seed are more than a quarter, and what is longer has a part of as many with three quarters equal."""
    for n, masks in SHORT_MASKS.items():
        seeds = [sum(1 << k + i for i, bit in enumerate(m) if bit == "1") for m in masks for k in range(n - len(m) + 1)]
        for c in itertools.combinations(range(n), n // 4):
            changed = sum(1 << x for x in c)
            assert any(not changed & s for s in seeds), (n, c)
    last = np.arange(1 << 12)[:, None] << 1 | np.arange(2)  # of 13 words, those at 1 are equal
    seeded = np.any([(last & int(m[::-1], 2)) == int(m[::-1], 2) for m in decontam.MASKS], axis=0)
    cost = np.where(np.arange(1 << 12) == 0, 0, 10**6)
    for n in range(1, 58):
        new = np.full(1 << 12, 10**6)
        np.minimum.at(new, last & 4095, np.where(seeded, 10**6, cost[:, None] + np.array([1, 0])))
        cost = new
        assert n < 13 or cost.min() > n / 4


def test_recall_over_all_placements():
    """Items of 5 to 40 words, as many words changed as three quarters allow, at random places: all are found."""
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=9))
    for n in range(5, 41):
        own = [word() for _ in range(n)]
        find = decontam._finder(decontam.seeds_of([(n, " ".join(own))]), 13, 0.75)
        texts = []
        for _ in range(60):
            changed = set(r.sample(range(n), n // 4))
            texts.append(" ".join([word() for _ in range(8)] + [word() if k in changed else w for k, w in enumerate(own)] + [word() for _ in range(8)]))
        assert {x[0] for x in find(pa.array(texts))} == set(range(60))


@pytest.mark.parametrize(("text", "item"), [("ha " * 300_000, "ha " * 300), ("ha ho " * 10_000, "ha ho " * 100), ("ha " * 7, "ha " * 6)])
def test_repeated_words_take_bounded_work(text, item):
    found = list(decontam._finder(decontam.seeds_of([(1, item)]), 13, 0.75)(pa.array([text])))
    n = len(item.split())
    assert found == [(0, 1, 0, 0, n, n)]


def test_decontamination_of_spread_substitutions(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=9))
    shapes = [(n, (k,)) for n in range(5, 14) for k in range(n)] + [(13, (3, 9)), (13, (3, 6, 9)), (15, (4, 7, 10)), *((n, range(3, n - 3, 4)) for n in (16, 30, 38, 59))]
    shapes += [(n, sorted(r.sample(range(n), n // 4))) for n in range(12, 40) for _ in range(6)]
    items, rows, want = [], [], set()
    for k, (n, changed) in enumerate(shapes):
        own = [word() for _ in range(n)]
        equal = np.array([i not in changed for i in range(n)])
        items.append((k, " ".join(own)))
        text = [word() for _ in range(20)] + [w if e else word() for w, e in zip(own, equal)] + [word() for _ in range(20)]
        rows.append((k, " ".join(text), "en", "s", 1))
        if stretch := longest(equal):
            start, end, same = stretch
            want.add((k, k, 20 + start, start, end - start, same))
    docs, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(x) for x in overlaps(docs, bench).collect()} == want
    # the same by a join of seeds that stay a table
    assert {tuple(x) for x in overlaps(docs, bench, sent_bytes=0).collect()} == want
    assert {x["doc_id"] for x in decontaminated(docs, bench, sent_bytes=0).collect()} == set(range(len(rows))) - {x[0] for x in want}
    assert {x["doc_id"] for x in decontaminated(docs, bench).collect()} == set(range(len(rows))) - {x[0] for x in want}
    with pytest.raises(ValueError, match="share"):
        overlaps(docs, bench, least_share=0.5)


def test_topk_equals_brute_force(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 8)) / 3
    x[50:90] = x[50]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(1000, None), (1020, [1.0, None, *[0.0] * 6]), (1040, [float("nan")] * 8), (None, [0.1] * 8), (1060, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = topk.top_k(table, 7, 20, 64).collect()
    # many blocks and tiles of both sides
    assert sorted(map(tuple, out)) == sorted(map(tuple, topk.top_k(table.coalesce(1), 7, 20, 64, candidates_in_block=9, queries_in_block=3).collect()))
    q = np.floor(64 * x.astype(np.float32).astype(float)).astype(int)
    got = defaultdict(list)
    for o in out:
        got[o["query_id"]].append((o["rank"], o["vec_id"], o["score"]))
    assert set(got) == set(range(0, 400, 20))
    for k, found in got.items():
        s = q @ q[k]
        best = sorted((-int(s[j]), j) for j in range(400) if j != k)[:7]
        assert sorted(found) == [(i + 1, j, -v) for i, (v, j) in enumerate(best)]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_topk_of_a_repeated_query_id(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(430, 64)) / 8
    x[:30] = x[0]
    ids = [20] * 30 + list(range(1000, 1400))
    out = topk.top_k(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").coalesce(1), 20, 20, 64)
    q = np.floor(64 * x.astype(np.float32).astype(float)).astype(int)
    best = sorted((-int(q[a] @ q[b]), ids[b]) for a in range(30) for b in range(30, 430))[:20]
    assert sorted((o["rank"], o["vec_id"], o["score"]) for o in out.collect() if o["query_id"] == 20) == [(k + 1, i, -v) for k, (v, i) in enumerate(best)]


def test_topk_resolves_few_candidates():
    v = np.floor(64 * np.random.default_rng(3).normal(size=(1500, 64)) / 8).astype(np.int64)
    search = topk.Search(np.arange(40), v[:40], 20)
    search.block(topk.Lists(np.arange(1500), v))
    assert search.resolved <= topk.FEW * 40 * 1500
    for q in range(40):
        s = v @ v[q]
        assert list(zip(search.scores[q], search.found[q])) == [(-a, b) for a, b in sorted((-s[j], j) for j in range(1500) if j != q)[:20]]


def test_ordinal_grades_share_weights():
    r = np.random.default_rng(0)
    n, size = 600, 12
    x = r.random((n, size)) < 0.3
    latent = x @ np.r_[2.5, 2.0, 1.5, np.zeros(size - 3)] + r.logistic(size=n) * 0.4
    grades = (latent > 1.5).astype(int) + (latent > 3) + (latent > 4.5)
    rows, columns = np.nonzero(x)
    w, t = toxicity.fit_ordinal(rows, columns, size, grades, steps=400)
    assert w[0] > w[1] > w[2] > abs(w[3:]).max() and (np.diff(t) > 0).all()


def test_toxicity_held_out(spark):
    r = random.Random(8)
    rows, labels = [], []
    for d in range(900):
        bad = d % 3 == 0
        w = words_text(r, 60).split()
        for _ in range(r.randint(2, 6) if bad else 0):
            w[r.randrange(60)] = r.choice(["vilename", "grossfool", "scumbag"])
        rows.append((d, " ".join(w), "en", "s", 1))
        if d % 2:
            labels.append((d, int(bad)))
    docs = docs_of(spark, rows + [(2000 + a[0], *a[1:]) for a in AWKWARD])
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    assert len(out) == 900 + len({a[0] for a in AWKWARD})
    wrong = sum(out[d]["rejected"] != (d % 3 == 0) for d in range(0, 900, 2))
    assert wrong <= 9 and not out[2001]["rejected"] and not out[2002]["rejected"]
    assert {x["doc_id"] for x in toxicity.drop_toxic(docs, model).collect()} == {d for d, x in out.items() if not x["rejected"]}
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).where("rejected").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_html(spark):
    model = html.fit_extractor(pages=250)
    held = [html.sample_page(random.Random(77_000 + k)) for k in range(120)]
    right = total = 0
    for source, kept in held:
        page = html.Page(source)
        got = set(model.texts([source])[0].split("\n\n"))
        total += len(page.text)
        right += sum((t in kept) == (t in got) for t in page.text)
    assert right / total > 0.95
    page = '<html><body><nav><ul><li><a href="/">home</a></li></ul></nav><article><h1>A &amp; B</h1><p>One  two&nbsp;three<br>four.</p><script>if (a < b) "</p>";</script><p><b>Five<br><p>Six &copy; seven eight nine ten.</p></article><div class="comments"><p>So true!</p></div><footer>&copy; x</footer></body></html>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<<<>"), (5, "u", "<p"), (6, "u", "<!-- x"), (7, "u", "<a href='" + "x" * 50000)]
    out = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert out[1]["text"] == "A & B\n\nOne two three four.\n\nFive\n\nSix © seven eight nine ten."
    assert out[1]["n_chars"] == len(out[1]["text"]) and out[2]["text"] == "" and out[3]["n_chars"] == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def test_decode_keeps_nothing_inside_what_is_dropped():
    page = html.Page("<div><section><p>a</p><p>b</p></section></div><div><p>c</p></div>")
    r = np.random.default_rng(1)
    for _ in range(50):
        kept = html.decode(page, r.normal(size=len(page.tag)) * 3)
        assert all(not kept[k] or kept[page.parent[k]] for k in range(1, len(kept)))


def test_digest_of_repeats_query_has_sha256(spark, sample):
    out = repeats.remove_repeats(docs_of(spark, sample[:3]), 200).select("doc_id", F.sha2("kept", 256).alias("h")).collect()
    assert {r["h"] for r in out} == {hashlib.sha256(t.encode()).hexdigest() for _, t, *_ in sample[:3]}

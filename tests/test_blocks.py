"""Blocks of the selection without Spark: what is said twice is scored once, and few pairs are worked out again."""

import numpy as np
import pyarrow as pa

from annalist.operators import selection as S


def rows(n, copies, seed=3):
    """Rows of random terms by size, each with copies, and as many queries as rows."""
    rng = np.random.default_rng(seed)
    texts = [np.sort(rng.zipf(1.3, 4 + i // 40) % 500).astype(np.int64) for i in range(n)]
    said = [(8 * len(t), t.tolist(), i) for i, t in enumerate(texts)]
    said = sorted((size, terms, i + n * k) for size, terms, i in said for k in range(copies))
    batch = pa.record_batch([pa.array([i for *_, i in said]), pa.array([s for s, *_ in said]), pa.array([[0.5 + s / 800] for s, *_ in said]), pa.array([[len(t)] for _, t, _ in said]), pa.array([t for _, t, _ in said])], names=["id", "bytes", "norms", "lengths", "terms"])
    asks = sorted((np.unique(t).tolist(), i + n * k) for i, t in enumerate(texts) for k in range(copies))
    asked = pa.record_batch([pa.array([i for _, i in asks]), pa.array([t for t, _ in asks]), pa.array([[1 + x % 7 / 3 for x in t] for t, _ in asks])], names=["qid", "terms", "weights"])
    return batch, asked


def picks(monkeypatch, batch, asked, width, items, bytes_, merge):
    """What the budget picks of the rows for the queries, the cells that were scored and the pairs that were worked out again."""
    monkeypatch.setattr(S, "ROWS", width)
    cells, pairs = [], []
    product, exact = S.product, S.exact
    monkeypatch.setattr(S, "product", lambda *a: cells.append((x := product(*a)).size) or x)
    monkeypatch.setattr(S, "exact", lambda *a: pairs.append(len(a[2])) or exact(*a))
    blocks = [b["d"][0].as_py() for b in S.row_blocks(iter([batch]), items + 1 if merge else 0)]
    asks = [b["q"][0].as_py() for b in S.query_blocks(iter([asked]), merge)]
    both = [pa.record_batch([pa.array([q], pa.binary()), pa.array([None], pa.binary()), pa.array([d], pa.binary())], names=["q", "best", "d"]) for q in asks for d in blocks]
    out = sorted(r for b in S.picked(iter(both), items, bytes_) for r in zip(*(b[c].to_pylist() for c in ("qid", "id", "relevance", "bytes"))))
    monkeypatch.undo()
    return out, sum(cells), sum(pairs)


def brute(batch, asked, items, bytes_):
    out = []
    docs = [(i, s, norm[0], dict(zip(*(x.tolist() for x in np.unique(t, return_counts=True)), strict=True))) for i, s, norm, t in zip(*(batch[c].to_pylist() for c in ("id", "bytes", "norms", "terms")), strict=True)]
    for qid, terms, weights in zip(*(asked[c].to_pylist() for c in ("qid", "terms", "weights")), strict=True):
        scored = [(-round(sum(w * t[x] / (t[x] + norm) for x, w in zip(terms, weights, strict=True) if x in t), 4), i, s) for i, s, norm, t in docs if i != qid and not t.keys().isdisjoint(terms)]
        used = got = 0
        for score, i, s in sorted(scored):
            if got < items and used + s <= bytes_:
                out.append((qid, i, -score, s))
                used, got = used + s, got + 1
    return sorted(out)


def test_copies_are_scored_once(monkeypatch):
    batch, asked = rows(90, 8)
    once, cells, _ = picks(monkeypatch, batch, asked, 1000, 5, 400, True)
    each, all_cells, _ = picks(monkeypatch, batch, asked, 1000, 5, 400, False)
    want = brute(batch, asked, 5, 400)
    assert [r[:2] for r in once] == [r[:2] for r in each] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in once], [r[2] for r in want])
    assert cells * 50 < all_cells


def test_few_pairs_reach_the_bound(monkeypatch):
    """Rows come by size: from the second block on a query's best ones so far leave few pairs."""
    batch, asked = rows(600, 1)
    some, cells, pairs = picks(monkeypatch, batch, asked, 25, 5, 400, True)
    assert [r[:2] for r in some] == [r[:2] for r in brute(batch, asked, 5, 400)]
    assert pairs * 10 < cells


def test_alike_but_not_the_same():
    """Lists of one length, or that go on as another ends, are no copies."""
    at = np.array([0, 2, 4, 4, 4, 6, 9, 12])
    assert S.differing(np.array([1, 2, 1, 2, 1, 3, 1, 3, 1, 1, 3, 1]), at).tolist() == [True, False, True, False, True, True, False]
    assert S.differing(np.zeros(0), np.array([0])).tolist() == []

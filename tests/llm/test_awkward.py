"""Every operator over rows without a doc_id, one doc_id with several texts, short texts alone, and columns of clashing names."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from annalist.llm import decontam, huffman, jaccard, lines, packing, prefixes, repeats, topk, toxicity
from tests.llm.test_operators import DOCS, brute_components, encode, words_text

LONG = "the boiler plate of every site that ever was and will be here"


def table(spark, rows):
    clash = "n_lines n_removed __id __gone doc hash gone row item_id n_tokens start ids sets spans kept rejected".split()
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in clash})


def texts(kind):
    import random

    r = random.Random(31)
    own = [words_text(r, 100) for _ in range(8)]
    if kind == "nulls":
        return [(None, own[0]), (None, own[1]), (3, own[0]), (None, None), (4, own[2]), (None, own[2] + " x"), (None, own[3])]
    if kind == "twice":
        return [(1, own[0]), (1, own[1]), (2, own[0] + " y"), (3, own[1] + " z"), (4, own[4]), (4, own[4]), (5, ""), (5, own[5])]
    return [(k, words_text(r, 5)) for k in range(30)]


KINDS = ["nulls", "twice", "short", "none"]


def docs_and_texts(spark, kind):
    rows = [] if kind == "none" else texts(kind)
    return table(spark, [(d, t, "en", f"s{k}", 1) for k, (d, t) in enumerate(rows)]), rows


@pytest.mark.parametrize("kind", KINDS)
def test_token_operators(spark, kind):
    docs, rows = docs_and_texts(spark, kind)
    want = sorted(((d, [*encode(t), 2]) for d, t in rows), key=str)
    got = huffman.token_ids(docs).collect()
    assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got), key=str) == want
    assert sorted((r["start"], r["n_tokens"]) for r in got) == sorted(zip(np.cumsum([0] + [r["n_tokens"] for r in sorted(got, key=lambda r: r["start"])])[:-1].tolist(), [r["n_tokens"] for r in sorted(got, key=lambda r: r["start"])]))
    pieces = packing.pack(docs, window=64).collect()
    assert sum(r["length"] for r in pieces) == sum(len(ids) for _, ids in want)
    assert {r["doc_id"] for r in pieces} == {d for d, _ in rows}
    for r in pieces:  # a piece is a stretch of one of the texts of its doc_id
        assert any(len(ids) == r["doc_tokens"] and zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for d, ids in want if d == r["doc_id"])
    held = Counter()
    for r in pieces:
        held.update((r["doc_id"], r["doc_tokens"], k) for k in range(r["start"], r["start"] + r["length"]))
    assert held == Counter((d, len(ids), k) for d, ids in want for k in range(len(ids)))
    counts = prefixes.prefix_counts(docs).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in counts), key=str) == sorted(((d, len((t or "").encode()), len(encode(t))) for d, t in rows), key=str)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("depth", [40, 200])
def test_repeats(spark, kind, depth):
    docs, rows = docs_and_texts(spark, kind)
    data = [(d, (t or "").encode()) for d, t in rows]
    counts = Counter(t[i : i + depth] for _, t in data for i in range(len(t) - depth + 1))
    want = []
    for d, t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - depth + 1):
            if counts[t[i : i + depth]] > 1:
                gone[i : i + depth] = True
        want.append((d, len(t), bytes(c for c, g in zip(t, gone) if not g)))
    got = [(r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in repeats.remove_repeats(docs, depth).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("kind", KINDS)
def test_near_duplicates(spark, kind):
    """Against brute force over rows, united by doc_id."""
    docs, rows = docs_and_texts(spark, kind)
    own = brute_components([(k, t) for k, (_, t) in enumerate(rows)], 5, 80, 100)
    part = {k: c for k, (_, c) in own.items()}
    for _ in rows:  # rows of one doc_id with words, and rows that link, fall to the least label of either
        for k, (d, _) in enumerate(rows):
            for j, (e, _) in enumerate(rows):
                if own[k][0] and own[j][0] and (own[k][1] == own[j][1] or (d is not None and d == e)):
                    part[k] = part[j] = min(part[k], part[j])
    ids = {}
    for k, (d, _) in enumerate(rows):
        if d is not None and own[k][0]:
            ids[part[k]] = min(ids.get(part[k], d), d)
    want = [(d, own[k][0], ids.get(part[k]) if own[k][0] else d) for k, (d, _) in enumerate(rows)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs, 5, 80, 100).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lines(spark):
    """A row of a doc_id that another row has loses its own lines alone; columns of the counts' names stay."""
    rows = [(k, f"own {k}\n{LONG}", "en", f"s{k}", 1) for k in range(12)] + [(5, "unique one\nunique two is not boilerplate", "en", "s1", 1), (None, f"a\n{LONG}\nb", "en", "s2", 1), (None, f"c\n{LONG}", "en", "s3", 1), (None, None, None, None, None)]
    docs = table(spark, rows)
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines_", "n_removed_"] and out.where("n_lines <> 7 or n_removed <> 7").count() == 0
    got = sorted((r["text"] or "", r["n_removed_"]) for r in out.collect())
    want = [(f"own 0\n{LONG}", 0)] + [(f"own {k}", 1) for k in range(1, 12)] + [("unique one\nunique two is not boilerplate", 0), ("a\nb", 1), ("c", 1), ("", 0)]
    assert got == sorted(want)


@pytest.mark.parametrize("kind", KINDS)
def test_overlaps(spark, kind):
    docs, rows = docs_and_texts(spark, kind)
    items = [(1, rows[0][1]), (2, None), (None, rows[0][1]), (1, "x " * 30)] if rows else [(1, "a b c d e f g")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    words = lambda t: (t or "").split()
    want = [d for d, t in rows if set(zip(*(words(rows[0][1])[k:] for k in range(5)))) & set(zip(*(words(t)[k:] for k in range(5))))]
    for sent in (decontam.BLOCK_BYTES, 0):
        got = [r["doc_id"] for r in decontam.overlaps(docs, bench, sent_bytes=sent).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        kept = decontam.decontaminated(docs, bench, sent_bytes=sent)
        assert kept.columns == docs.columns and kept.count() == len(rows) - len(want)


@pytest.mark.parametrize("kind", KINDS)
def test_toxicity(spark, kind):
    docs, rows = docs_and_texts(spark, kind)
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, 1), (None, 1), (4, 0), (5, 0), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(d) for d, _ in rows)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert all(0 <= r["expected_severity"] <= 2 and r["rejected"] == (r["expected_severity"] >= toxicity.REJECT) for r in out)
    scores = Counter((r["doc_id"], r["expected_severity"]) for r in out)  # rows that are equal have one score, others one each
    assert len(scores) >= len({d for d, _ in rows}) and sum(scores.values()) == len(rows)
    kept = Counter(r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect())
    assert kept == Counter(r["doc_id"] for r in out if not r["rejected"])


def test_top_k_of_one_length_each(spark):
    rows = [(0, [0.5]), (1, [0.25, 1.0]), (None, [0.5]), (20, []), (40, [1.0]), (60, [0.5])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"query_id": F.lit(1), "rank": F.lit(1), "tile": F.lit(2)}), 3)
    assert {tuple(r) for r in out.collect()} == {(0, 1, 40, 2048), (0, 2, 60, 1024), (40, 1, 0, 2048), (40, 2, 60, 2048), (60, 1, 40, 2048), (60, 2, 0, 1024)}


@pytest.mark.parametrize("kind", ["nulls", "none"])
def test_pipeline(spark, kind, tmp_path):
    docs, rows = docs_and_texts(spark, kind)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of all that is in here at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = Counter()
    for r in out:
        tokens[r["doc_id"]] += r["length"]
    assert set(tokens) <= {d for d, _ in rows} and (kind != "nulls" or None in tokens)

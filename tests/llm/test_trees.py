"""Tree concatenation and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import queries, tokens, trees
from tests.llm.test_operators import AWKWARD, docs_of, words_text

PATH = tokens.vocabulary_path()


def library(text):
    return tokens.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def alphabet(r):
    return r.choice(["ab", "a", "abc", "thein", "éßa", "世界人", "'s12", "-=_", "aéb世 ", "é", "Σσİ", "<|endoftext|>", "\U0001f600a"])


def test_trees_equal_the_library():
    of = trees.leaves_of(PATH)
    r = random.Random(3)
    for _ in range(3000):
        letters = alphabet(r)
        run = "".join(r.choice(letters) for _ in range(r.randint(1, 200)))
        ids = []
        for word in of.words(run):
            if isinstance(word, int):
                ids.append(word)
            else:
                leaves = trees.stretches(word, r.choice([1, 2, 3, 5, 16]))
                ids += of.tree([of.encode(x, k + 1 == len(leaves)) for k, x in enumerate(leaves)]).tolist()
        assert ids == library(run)


@pytest.mark.parametrize("run", ["a" * 300_001, "abcdefgh" * 40_000, "世界" * 60_000, "'s" * 50_000, "<|endoftext|>" * 50_000, "é" * 50_000])
def test_very_long_runs(run):
    of = trees.leaves_of(PATH)
    ids = []
    for word in of.words(run):
        if isinstance(word, int):
            ids.append(word)
        else:
            leaves = trees.stretches(word, 4096)
            ids += of.tree([of.encode(x, k + 1 == len(leaves)) for k, x in enumerate(leaves)]).tolist()
    assert ids == library(run)


@pytest.mark.parametrize("leaf", [8, 4096])
def test_round_trip_of_awkward_rows(spark, leaf):
    r = random.Random(8)
    rows = [(k, "".join(r.choice(alphabet(r)) for _ in range(r.choice([5, 60, 900]))) + r.choice(["", " ", "\n", "　"]) + words_text(r, r.randint(0, 30)), "en", "s", 1) for k in range(60, 120)]
    rows += [*AWKWARD, (None, "no id " + "z" * 6000, "en", "s", 1), (None, None, None, None, None), (8, "x" * 5000 + " " + "y" * 5000 + "ab cd", "en", "s", 1), (9, "ab" * 400_000, "en", "s", 1)]
    docs = docs_of(spark, rows)
    coded = trees.encode(docs, leaf=leaf)
    out = [(x["doc_id"], x["ids"], x["decoded"]) for x in trees.decode(coded).collect()]
    want = [(d, ids := library(t), tokens.tokenizer(PATH).decode(ids, skip_special_tokens=False)) for d, t, *_ in rows]
    assert sorted(out, key=str) == sorted(want, key=str)


def test_decode_of_any_ids(spark):
    """Null ids, none, special ones, ids out of the vocabulary, a column that has the name."""
    rows = [(1, None), (2, []), (3, [49406, 320, 49407]), (4, [320, 99999, 320]), (5, [5, 6, 7])]
    out = trees.decode(spark.createDataFrame(rows, "k int, ids array<int>").withColumn("decoded", F.lit("own")))
    assert out.columns == ["k", "ids", "decoded", "decoded_"]
    library = tokens.tokenizer(PATH)
    want = {k: None if ids is None else library.decode(ids, skip_special_tokens=False) for k, ids in rows}
    assert {x["k"]: x["decoded_"] for x in out.collect()} == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op12_bpe_round_trip(spark, sf).collect()
    assert len(rows) == len(docs)
    for x in rows:
        ids = library(docs[x["doc_id"]])
        text = tokens.tokenizer(PATH).decode(ids, skip_special_tokens=False)
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_empty_table(spark):
    assert trees.decode(trees.encode(docs_of(spark, AWKWARD).limit(0))).count() == 0


def test_windows_grow_until_both_sides_agree():
    """Letters that merge in pairs shift by one across the whole right side, so that nothing but the end agrees."""
    of = trees.leaves_of(PATH)
    left, right = of.encode("a" * 1001, False), of.encode("a" * 1000, True)
    assert np.array_equal(of.joined(left, right, True), library("a" * 2001))

"""Prefix counts of awkward runs: special tokens in rows, decomposed letters, marks that change places."""

import random
import time
import unicodedata

import pyarrow as pa
import pytest

from annalist.llm import prefixes, tokens
from annalist.llm.common import text_bytes

PATH = tokens.vocabulary_path()


def nfd(s):
    return unicodedata.normalize("NFD", s)


def counted(counter, text):
    return counter.counts(*text_bytes(pa.array([text])))[0].tolist()


def library(text):
    return len(tokens.tokenizer(PATH).encode(text, add_special_tokens=False).ids)


def test_every_prefix_equals_the_library():
    counter, r = prefixes.Counter(PATH), random.Random(5)
    alphabets = [list("aé'sre") + ["́", "<|endoftext|>"], [*nfd("éàüñ"), "a"], list("'srevldm!1") + ["́"], list("한국어"), list(nfd("한국어")), ["İ", "Σ", "ß", "́", "a", "'", "s", " ", "　"], ["q", "́", "̣", "̖", "1", "!", "'"]]
    for _ in range(700):
        letters = r.choice(alphabets)
        text = "".join(r.choice(letters) for _ in range(r.randint(1, 40)))
        assert counted(counter, text) == [library(text[:e]) for e in range(1, len(text) + 1)]


@pytest.mark.parametrize("text", ["<|endoftext|>" * 100_000, nfd("é") * 100_000, nfd("한국어") * 20_000, ("é" + nfd("é!'s1")) * 10_000, "q" + "́" * 50_000, "a" * 200_000])
def test_long_runs_take_time_in_proportion(text):
    began = time.process_time()
    assert counted(prefixes.Counter(PATH), text)[-1] == library(text)
    assert time.process_time() - began < 30

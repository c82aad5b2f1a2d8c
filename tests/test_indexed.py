"""The index cuts each text into words once; words of awkward texts."""

import re

from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.functions import vocab as V
from annalist.sources import postings


def test_texts_are_cut_up_once(spark, tmp_path, monkeypatch):
    """Four times before: ranges were drawn from rows with their words, and both tables were made from the start."""
    seen = spark.sparkContext.accumulator(0)

    def cut(text):
        seen.add(1)
        return text.split()

    monkeypatch.setattr(postings.T, "tokens", F.udf(cut, "array<string>").asNondeterministic())
    rows = spark.createDataFrame([(k, f"word w{k % 7} w{k % 3} word") for k in range(600)] + [(600, None), (601, "")], "id long, content string").repartition(5)
    postings.add(rows, str(tmp_path / "index"), "0")
    assert seen.value == 602
    read = lambda name: spark.read.parquet(str(tmp_path / "index" / name / "generation=0"))
    assert read("totals").first().asDict() == {"n": 602, "dl": 2400}
    assert read("postings").where("term = 'word'").agg(F.count("*"), F.sum("tf"), F.min("dl")).first() == (600, 1200, 4)
    assert read("docs").count() == 602


def test_words(spark):
    texts = ["", None, "a", "The Quick_brown F0x a 7 77", "KKelvin İstanbul ıx İ", "Straße ÀB cD É", "我们ab去c北京 的", "中", "x中y zz", "ＡＢ ab", "A" * 50]

    def words(text):
        out = []
        for run in re.findall("[A-Za-z0-9_]+|[一-鿿]+", text or ""):
            if run[0] >= "一":
                out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
            elif len(run) > 1 and run.lower() not in V.STOP_WORDS:
                out.append(run.lower())
        return out

    rows = spark.createDataFrame(list(enumerate(texts)), "k int, c string").select("k", T.tokens(F.col("c")).alias("t")).collect()
    assert {r["k"]: r["t"] for r in rows} == {k: words(t) for k, t in enumerate(texts)}

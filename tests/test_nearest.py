"""Nearest vectors against the plain product of all pairs; blocks leave the planner no row per pair."""

import pytest
from pyspark.sql import functions as F

from annalist.operators import vector
from annalist.operators.lexical import top_each


def test_nearest(spark):
    rows = [(i, [float(i * i % 7 - 3), float(i % 5), 1.0], None if i % 13 == 5 else i % 3) for i in range(2300)] + [(5000, None, 1)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>, label int")
    q = v.where("id % 100 = 0")
    pairs = q.select(F.col("id").alias("qid"), F.col("embedding").alias("q"), F.col("label").alias("l")).join(v, F.expr("id <> qid"))
    pairs = pairs.select("qid", "id", (F.col("label") == F.col("l")).cast("int").alias("same"), vector.cosine(F.col("embedding"), F.col("q")).alias("similarity"))
    ten = lambda x: sorted(map(str, top_each(x, "qid", 10, F.desc_nulls_last("similarity"), "id").select("qid", "id", "same", "similarity").collect()))
    some = vector.nearest(v, q, 10)
    assert ten(some) == ten(pairs)
    assert some.count() < pairs.count() // 10


def test_bad_vectors(spark):
    for bad in ([1.0], [float("nan"), 1.0], [0.0, 0.0]):
        v = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, bad, 1)], "id long, embedding array<double>, label int")
        with pytest.raises(Exception, match="vectors must be"):
            vector.nearest(v, v.where("id = 0"), 10).collect()

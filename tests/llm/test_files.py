"""The files that token ids are written to."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from annalist.llm import huffman
from tests.llm.test_operators import docs_of, encode, words_text


@pytest.mark.parametrize("parts", ["1", "5"])
def test_blocks_ascend_on_disk(spark, tmp_path, parts):
    """Files in the order of their names hold the documents in the order of their ids, null ones first, whatever the partitions."""
    r = random.Random(4)
    rows = [(k, words_text(r, r.randint(0, 300)), "en", "s", 1) for k in range(200)] + [(None, "no id", "en", "s", 1), (None, None, "en", "s", 1)]
    r.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        huffman.write_ids(docs_of(spark, rows).repartition(7), str(tmp_path / "ids"), size_of_block=500)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[1])
    firsts = [x for f in sorted((tmp_path / "ids/blocks").glob("range=*/part-*.parquet")) for x in pq.ParquetFile(f).read(["first"])["first"].to_pylist()]
    assert firsts == sorted(firsts) and len(firsts) > 20
    got = huffman.read_ids(spark, str(tmp_path / "ids")).orderBy(F.col("doc_id").asc_nulls_first(), "start").collect()
    assert [x["start"] for x in got] == [sum(y["n_tokens"] for y in got[:k]) for k in range(len(got))]
    lengths = sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["n_tokens"]) for x in got)
    assert lengths == sorted((d if d is not None else -1, len(encode(t)) + 1) for d, t, *_ in rows)

"""What the operators share: the shared folder, Arrow text buffers and packed records."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch: bound a worker's memory when rows are long documents, or blocks of many.
ROWS_PER_BATCH, BYTES_PER_BATCH = 512, 8 << 20
#: Bytes of text that numpy code takes at a time, so that its temporaries stay small.
SLICE_BYTES = 2 << 20


def prepare(spark: SparkSession) -> None:
    """Session settings that the Arrow operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


#: Paths that shared_path() gave out, for cleared().
_paths: list[str] = []


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent a temporary folder is used if all of Spark runs on this machine (tests); on a cluster, whose
    machines don't share such a folder, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_annalist_dir", None) or tempfile.mkdtemp(prefix="annalist-")
        spark._annalist_dir = base
    _paths.append(f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}")
    return _paths[-1]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of stored() frames that nothing reads any more."""
    for df in tables:
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            deleted(df.sparkSession, f)


def marked() -> int:
    """How many paths operators have been given: what they write from now on is cleared(..., since=marked())."""
    return len(_paths)


def cleared(spark: SparkSession, keep: DataFrame | None = None, since: int = 0, until: int | None = None) -> None:
    """Delete what operators have written to the shared folder since a mark (and before another), but for what ``keep`` reads.

    Results are lazy and read such tables: call it once all results that matter are written.
    """
    kept = {p.rsplit("/", 1)[0].rsplit("/", 1)[-1] for p in keep.inputFiles()} if keep is not None else set()
    for k in range(since, len(_paths) if until is None else until):
        if _paths[k] and _paths[k].rsplit("/", 1)[-1] not in kept:
            deleted(spark, _paths[k])
            _paths[k] = ""


def lean(function):
    """The same function over Arrow batches, giving freed memory back to the system after every 64 MB and at the end: workers
    live on, and what their allocators keep counts against the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[pa.RecordBatch]:
            size = 0
            for batch in batches:
                size += batch.nbytes
                yield batch
                if size > 64 << 20:
                    size = 0
                    release()

        yield from function(counted())
        release()

    return run


def release() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver's garbage is
    collected, which on an idle driver may take long."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(df: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator reads, so that clashing names of others don't matter; a null text is empty."""
    return df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text), *more)


def free(name: str, taken: list[str]) -> str:
    """The name, with underscores until no column has it."""
    names = {t.lower() for t in taken}
    while name.lower() in names:
        name += "_"
    return name


def row_key() -> tuple[Column, Column]:
    """What names a row of documents: its doc_id, and a hash of its text (and of whether the doc_id is null)."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull())


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    base = int(offsets[0]) if len(offsets) else 0
    return raw[base : int(offsets[-1]) if len(offsets) else 0], offsets - base


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def gathered(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about ``limit`` bytes: work for each distinct word of a batch is shared by more text."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(start, start + length)`` for every pair."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths) + np.arange(total)


PACKED = "bucket int, blob binary"


#: Buckets that a task takes, one after the other: it holds one at a time.
BUCKETS_PER_TASK = 8


def by_bucket(df: DataFrame, tasks: int) -> DataFrame:
    """Packed rows dealt out by bucket to so many tasks, those of one bucket together and in a row."""
    return df.repartition(tasks, "bucket").sortWithinPartitions("bucket")


def planes(records: np.ndarray) -> bytes:
    """Records byte by byte, the first bytes of all, then the second ones, compressed: what is alike lies side by side, and the
    shuffle's own compression, a faster one, can't make it smaller."""
    raw = records.view(np.uint8).reshape(len(records), records.dtype.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def unplanes(data: bytes, dtype: np.dtype) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(memoryview(data)[8:], size, asbytes=True), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(raw.T).view(dtype).ravel()


def runs_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of rows that are equal in all keys; none of no rows."""
    n = len(keys[0])
    fresh = np.zeros(n, bool)
    fresh[:1] = True
    for key in keys:
        fresh[1:] |= key[1:] != key[:-1]
    heads = np.flatnonzero(fresh)
    return heads, np.r_[heads, n][1:]


def dealt(bucket: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """Records (a structured array) as one binary row per bucket: the shuffle moves a few blobs, not a row per record."""
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    heads, ends = runs_of(bucket)
    return pa.record_batch([pa.array(bucket[heads].astype(np.int32)), pa.array([planes(records[a:b]) for a, b in zip(heads, ends, strict=True)], pa.binary())], names=["bucket", "blob"])


def buckets_of(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[np.ndarray]:
    """The records of one bucket after the other."""
    now, parts = None, []
    for batch in batches:
        for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if b != now and parts:
                yield np.concatenate(parts)
                parts = []
            now = b
            parts.append(unplanes(data, dtype))
    if parts:
        yield np.concatenate(parts)

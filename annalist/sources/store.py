"""Tables that a job writes for itself, in the folder that driver and executors share, and keyed tables that live on."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where that is unset, a temporary folder if all of Spark runs on this
    machine (tests); on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_annalist_tables", None) or tempfile.mkdtemp(prefix="annalist-")
        spark._annalist_tables = base
    return base.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df as a table that was written and is read again: computed once, the same each time, safe from lost executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fingerprint(spark: SparkSession, path: str) -> str:
    """What a folder or file looked like: its path, bytes, files, and when it was written last."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(at)
    newest = max((s.getModificationTime() for s in fs.listStatus(at)), default=0)
    return hashlib.sha256(f"{path} {summary.getLength()} {summary.getFileCount()} {newest}".encode()).hexdigest()[:16]


def kept(spark: SparkSession, name: str, source: str, build) -> DataFrame:
    """A table derived from a source table: built once for each state of the source, then read."""
    path = f"{shared_folder(spark)}/{name}-{fingerprint(spark, source)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

"""A keyed table of files: upserts as deltas, merge on read, compaction, lookups that read the keys' folders only.

Rows lie in folders by a hash of their key.  A write adds a delta with a number of its own; the same number again replaces it, so
a batch that is run again changes nothing.  Reading merges: the last row that was put stands, whatever was only offered; else the
first one that was offered.  Compaction writes what reading gives as a new base and leaves later deltas alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.sources.store import deleted, exists

PUT, OFFER = "put", "offer"


@dataclass
class KeyedTable:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = 32

    def bucket(self) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("\x1e")) for k in self.keys)), 256), 1, 8), 16, 10).cast("long") % self.buckets

    def write(self, rows: DataFrame, number: int, order: str, kind: str = PUT) -> None:
        """Add rows as delta ``number`` (from 1): PUT replaces a key's row, OFFER only stands where there is none.  Of rows of one
        key the last by ``order`` is put, the first is offered.  Columns may be more or fewer than before: what a row lacks is null."""
        if kind not in (PUT, OFFER):
            raise ValueError(f"a row is {PUT} or {OFFER}")
        held = F.struct(F.col(order).alias("_order"), F.struct(*rows.columns).alias("_row"))
        one = rows.groupBy(*self.keys).agg((F.max if kind == PUT else F.min)(held).alias("_one")).select("_one._row.*")
        path = f"{self.path}/delta/_number={number}"
        if rows.isEmpty():  # files without a row tell no schema
            deleted(self.spark, path)
        else:
            self._save(one.withColumn("_put", F.lit(kind == PUT)), path)

    def _save(self, rows: DataFrame, path: str) -> None:
        rows.withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *self.keys).write.mode("overwrite").partitionBy("_bucket").parquet(path)

    def _numbers(self, kind: str) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("_number=") and exists(self.spark, f"{self.path}/{kind}/{n}/_SUCCESS"))

    def _parts(self) -> list[str]:
        """The folders that count: the newest base, and the deltas after it."""
        base = max(self._numbers("base"), default=0)
        return [f"{self.path}/base/_number={base}"] * bool(base) + [f"{self.path}/delta/_number={n}" for n in self._numbers("delta") if n > base]

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, one for each key; of some buckets only, if they are given."""
        return self._merged(buckets).drop("_put")

    def _merged(self, buckets: list[int] | None = None) -> DataFrame:
        folders = self._parts()
        if not folders:
            raise ValueError(f"nothing was written to {self.path}")
        rows = None
        for folder in folders:  # one schema each: columns came and went
            part = self.spark.read.parquet(folder).withColumn("_number", F.lit(int(folder.rsplit("=", 1)[1])))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        if buckets is not None:
            rows = rows.where(F.col("_bucket").isin(buckets))
        names = [c for c in rows.columns if not c.startswith("_")]
        rank = F.struct("_put", F.when(F.col("_put"), F.col("_number")).otherwise(-F.col("_number")).alias("at"))
        held = F.struct(*(c for c in names if c not in self.keys), F.col("_put"))
        merged = rows.groupBy("_bucket", *self.keys).agg(F.max_by(held, rank).alias("_one"))
        return merged.select(*self.keys, "_one.*").select(*names, "_put")

    def compact(self) -> None:
        """Writes the base anew with all deltas that there are."""
        number = max([*self._numbers("delta"), *self._numbers("base")], default=0)
        if number > max(self._numbers("base"), default=0):
            self._save(self._merged(), f"{self.path}/base/_number={number}")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows of the keys in ``wanted``, from their folders only."""
        own = wanted.select(*self.keys).distinct().withColumn("_bucket", self.bucket())
        buckets = [r["_bucket"] for r in own.select("_bucket").distinct().collect()]  # as many as there are folders, at most
        return self.read(buckets).join(own.drop("_bucket"), list(self.keys), "left_semi")

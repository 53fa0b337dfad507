"""State tables partitioned by a hash of the key: a batch rewrites the partitions of its own keys and no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..operators.state import upsert


class BucketedTable:
    """A keyed table in Parquet partitions `bucket=<hash of the key>`.

    A batch finds the buckets of its keys, computes their next rows from theirs alone, and writes them in three steps: a staged copy,
    the overwrite of these partitions (Spark's dynamic partition overwrite), and a marker. A batch that runs again does nothing
    once marked; with its staged copy complete it repeats the overwrite from that; else it starts over, from a table it has not
    touched. Batches come one after the other, by number. Keys are not null. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("rows").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs().exists(self._path(name))

    def bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int"))

    def exists(self) -> bool:
        return self._exists("done")

    def _rows(self) -> DataFrame:
        columns = self.spark.read.parquet(f"{self.folder}/columns").schema  # a table that has lost its last row has no files
        return self.spark.read.schema(columns.add("bucket", IntegerType())).parquet(f"{self.folder}/rows")

    def read(self) -> DataFrame:
        """The table's rows."""
        return self._rows().drop("bucket")

    def apply(self, incoming: DataFrame, batch: int, step: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """step(stored, incoming) gives the next rows; it gets the stored rows of the batch's buckets and may drop or add rows
        of the batch's keys. The first batch gives the table its columns: step gets its incoming rows and an empty table."""
        if self._exists(f"done/batch-{batch}"):
            return
        if not self._exists(f"staged/batch-{batch}/rows/_SUCCESS"):
            self._stage(incoming, batch, step)
        self._overwrite(batch)
        self._fs().create(self._path(f"done/batch-{batch}"), True).close()
        self._fs().delete(self._path(f"staged/batch-{batch}"), True)

    def _stage(self, incoming: DataFrame, batch: int, step: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """The batch's buckets, then their next rows."""
        staged = f"{self.folder}/staged/batch-{batch}"
        touched = sorted(r["bucket"] for r in self.bucketed(incoming).select("bucket").distinct().collect())  # at most `buckets`
        if self.exists():
            stored = self._rows().filter(F.col("bucket").isin(touched)).drop("bucket")
        else:
            stored = incoming.limit(0)
            step(stored, stored).limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/columns")
        self.spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{staged}/buckets")
        self.bucketed(step(stored, incoming)).repartition("bucket").write.mode("overwrite").parquet(f"{staged}/rows")

    def _overwrite(self, batch: int) -> None:
        """The staged rows in place of their buckets'; a bucket without rows goes."""
        staged = f"{self.folder}/staged/batch-{batch}"
        rows = self.spark.read.parquet(f"{staged}/rows")
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/rows")
        left = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
        for r in self.spark.read.parquet(f"{staged}/buckets").collect():
            if r["bucket"] not in left:
                self._fs().delete(self._path(f"rows/bucket={r['bucket']}"), True)

    def merge(self, incoming: DataFrame, batch: int, **how) -> None:
        """state.upsert of a batch's rows, one for each key."""
        self.apply(incoming, batch, lambda stored, rows: upsert(stored, rows, self.key, **how))

"""Micro-batches with stored state, and event-time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folders import work_folder  # noqa: F401
from ..operators.state import changes, latest_per_key, upsert
from .buckets import BucketedTable


class SnapshotTable:
    """A keyed state table as one Parquet snapshot for each batch, of which the last `keep` stay.

    A batch that runs again after a failure starts from the snapshot before it, so replays change nothing. Each batch rewrites the
    snapshot, which suits small results (windows); `buckets.BucketedTable` rewrites only what a batch touches.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> dict[int, str]:
        """Complete snapshots by batch."""
        path, fs = self.spark._jvm.org.apache.hadoop.fs.Path, self._fs()
        if not fs.exists(path(self.folder)):
            return {}
        found = {}
        for s in fs.listStatus(path(self.folder)):
            name = s.getPath().getName()
            if name.startswith("batch-") and fs.exists(path(f"{self.folder}/{name}/_SUCCESS")):
                found[int(name.split("-")[1])] = f"{self.folder}/{name}"
        return found

    def before(self, batch: int) -> DataFrame | None:
        older = {k: p for k, p in self.versions().items() if k < batch}
        return self.spark.read.parquet(older[max(older)]) if older else None

    def current(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(found[max(found)]) if found else None

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")
        for number, old in self.versions().items():
            if number <= batch - self.keep:
                self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(old), True)


def upsert_stream(stream: DataFrame, table: BucketedTable, order: list, checkpoint: str, **merge) -> DataFrame:
    """Runs what is available now: each batch's latest rows by key are merged into the state table."""

    def batch(df: DataFrame, number: int) -> None:
        table.merge(latest_per_key(df, table.key, order), number, **merge)

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read()


def diff_stream(stream: DataFrame, table: SnapshotTable, key: str, order: list, checkpoint: str, events: str, **merge) -> DataFrame:
    """As keyed.keyed_changes, by a join with a snapshot of all keys: for state tables that other jobs read as they are. Each batch's
    events (see state.changes) are written under `events` as (batch, key, events). A batch that runs again overwrites its own
    events, and rows equal to what is stored give none."""

    def batch(df: DataFrame, number: int) -> None:
        incoming = latest_per_key(df, key, order)
        stored = table.before(number)
        known = incoming.limit(0) if stored is None else stored
        changes(incoming, known, key).filter(F.size("events") > 0).select(F.lit(number).cast("long").alias("batch"), key, "events").write.mode("overwrite").parquet(f"{events.rstrip('/')}/batch-{number}")
        table.write(incoming if stored is None else upsert(stored, incoming, key, **merge), number)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table.spark.read.parquet(f"{events.rstrip('/')}/batch-*")


def run_complete(aggregated: DataFrame, table: SnapshotTable, checkpoint: str) -> DataFrame:
    """An aggregation over what is available now, all its windows, closed or not, as the newest snapshot."""
    aggregated.writeStream.outputMode("complete").foreachBatch(lambda df, number: table.write(df, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table.current()


def tumbling_counts(events: DataFrame, at: str = "ts", width: str = "1 day", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Counts and sums by window and type; works for streams (with a watermark) and tables alike."""
    source = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events
    out = source.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "total")


def session_counts(events: DataFrame, at: str = "ts", gap: str = "6 hours", late: str = "2 hours", by: str = "user_id") -> DataFrame:
    source = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events
    out = source.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_to_table(stream: DataFrame, folder: str, schema_of: DataFrame) -> DataFrame:
    """Appends what is available now to Parquet and reads it back."""
    out = f"{folder.rstrip('/')}/out-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return schema_of.sparkSession.read.schema(schema_of.schema).parquet(out)

"""State by key in a state store: what each micro-batch changes, and notices that close.

The store (RocksDB, in the checkpoint folder) keeps one value for each key, so a batch reads and writes the keys it brings and no
others, however many are stored; a restart goes on from the checkpoint. Timers in event time end keys that have closed.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What is kept of a key; times travel as microseconds.
KEPT = "amendment bigint, close_date bigint, attachment_hash string, first_seen bigint, last_seen bigint"
TIMES = ("close_date", "first_seen", "last_seen")


def larger(a, b):
    return max((x for x in (a, b) if x is not None), default=None)


class NoticeState(StatefulProcessor):
    """Per key: the stored notice, what the batch's latest row changes in it, and a timer `grace` after it closes."""

    def __init__(self, grace: timedelta | None):
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("notice", KEPT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        order = lambda r: [(r[c] is not None, r[c] if r[c] is not None else 0) for c in ("close_date", "amendment")] + [r["attachment_hash"] or ""]
        new = max(rows, key=order)
        at, was = new["at"], self.stored.get()
        amendment, close, attached = new["amendment"], new["close_date"], new["attachment_hash"]
        if was is None:
            events, first = ["new"], at
        else:
            old_amendment, old_close, old_attached, first, last = was
            events = ["amendment"] * (amendment is not None and amendment > (-1 if old_amendment is None else old_amendment))
            events += ["close_date_changed"] * (close != old_close) + ["new_attachment"] * bool(attached and attached != old_attached)
            amendment, at = larger(amendment, old_amendment), larger(at, last)
        self.stored.update((amendment, close, attached, first, at))
        if self.grace is not None and close is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            ends = -(-close // 1000) + self.grace // timedelta(milliseconds=1)
            self.handle.registerTimer(max(ends, timerValues.getCurrentWatermarkInMs() + 1))
        yield Row(key=key[0], events=events, amendment=amendment, close_date=close, attachment_hash=attached, first_seen=first, last_seen=at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        was = self.stored.get()
        if was is not None:
            self.stored.clear()
            yield Row(key=key[0], events=["closed"], amendment=was[0], close_date=was[1], attachment_hash=was[2], first_seen=was[3], last_seen=was[4])

    def close(self) -> None:
        pass


def keyed_changes(stream: DataFrame, late: str | None = None, grace: timedelta | None = None) -> DataFrame:
    """(key, events, amendment, close_date, attachment_hash, first_seen, last_seen) of each key in each batch.

    stream has key, amendment, close_date, attachment_hash and seen_at; of a batch's rows of a key the latest counts (by close
    date, amendment, hash). events are those of state.changes, possibly none; the amendment never falls, first_seen stays. With
    `grace`, a key whose notice closed that long before the watermark (`late` behind the newest seen_at) leaves the store with
    the event `closed`; seen again, it is new. Nulls: a null amendment or hash changes nothing, a notice without close date never
    closes.
    """
    kind = stream.schema["key"].dataType.simpleString()
    source = stream.withWatermark("seen_at", late or "0 seconds") if grace is not None else stream
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    source = source.select("key", F.col("amendment").cast("long").alias("amendment"), micros("close_date").alias("close_date"), "attachment_hash", micros("seen_at").alias("at"), "seen_at")
    found = source.groupBy("key").transformWithState(NoticeState(grace), f"key {kind}, events array<string>, {KEPT}", "Update", "EventTime" if grace is not None else "None")
    return found.withColumns({c: F.timestamp_micros(c) for c in TIMES})


def run_keyed(changes: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Runs what is available now; each batch's rows are written under the folder as batch-<n>, anew if the batch runs again.
    Returns all batches' rows so far with their batch."""

    spark: SparkSession = changes.sparkSession
    out = f"{folder.rstrip('/')}/batch="

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}{number}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = changes.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    return spark.read.schema(changes.schema.add("batch", "long")).option("basePath", folder).parquet(f"{out}*")

"""Event-time windows that close: results in append mode, late rows kept aside, and joins of two streams within an interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _run(writer, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def appended(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """What a stream has for good (append mode) of what is available now, added to the Parquet folder; the folder read."""
    _run(stream.writeStream.format("parquet").option("path", folder).outputMode("append"), checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def closed_windows(events: DataFrame, at: str, width: str, late: str, by: list[str], *aggregates: Column) -> DataFrame:
    """(window_start, window_end, by, aggregates) of windows that the watermark, `late` behind the newest event, has passed. Rows of
    windows that had closed before their batch are dropped (late_rows keeps them)."""
    found = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(*aggregates)
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *[c for c in found.columns if c not in ("w", *by)])


def _maxima(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("newest timestamp, batch long").option("basePath", folder).parquet(f"{folder}/batch=*")


def late_rows(events: DataFrame, folder: str, checkpoint: str, at: str, width: str, late: str) -> DataFrame:
    """The rows that closed_windows drops, from the same source in the same batches: those whose window lay at or before the watermark
    that the batch before was run with. Each batch writes its newest time and its late rows under its number, anew if it runs
    again; rows without a time belong to no window and count as late."""
    spark, kept, seen = events.sparkSession, f"{folder}/late", f"{folder}/newest"

    def batch(df: DataFrame, number: int) -> None:
        newest = df.agg(F.date_trunc("MILLISECOND", F.max(at)).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{seen}/batch={number}")
        known = _maxima(spark, seen).filter(F.col("batch") <= number - 2).agg((F.max("newest") - F.expr(f"INTERVAL {late}")).alias("mark")).first()["mark"]
        passed = F.lit(False) if known is None else F.window(at, width)["end"] <= F.lit(known)
        df.filter(F.col(at).isNull() | passed).write.mode("overwrite").parquet(f"{kept}/batch={number}")

    _run(events.writeStream.foreachBatch(batch), checkpoint)
    return spark.read.schema(events.schema.add("batch", "long")).option("basePath", kept).parquet(f"{kept}/batch=*")


def with_followers(first: DataFrame, then: DataFrame, key: str, at: str, then_at: str, within: str, late: str) -> DataFrame:
    """Each row of `first` with the rows of `then` of the same key at most `within` after it; one without any comes, with nulls, once the
    watermark shows that none can follow. The state of either side is bounded by `within` and `late`; `then` has no other column
    of the same name than the key."""
    left = first.withWatermark(at, late)
    right = then.withColumnRenamed(key, f"__{key}").withWatermark(then_at, late)
    met = (left[key] == right[f"__{key}"]) & (right[then_at] >= left[at]) & (right[then_at] <= left[at] + F.expr(f"INTERVAL {within}"))
    return left.join(right, met, "left_outer").drop(f"__{key}")

"""How rows are spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def planned_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a DataFrame's size, of files that of their bytes; nothing is read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, if its files make fewer: less than a full partition of bytes for each core. A large
    table stays as it is scanned. For rows that cost much more than their shuffle."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    full = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if cores > 1 and planned_bytes(df) < cores * full else df

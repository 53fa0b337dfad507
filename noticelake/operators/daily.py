"""Daily partial sums: one small table of which any window, change and rate is a difference of running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_parts(rows: DataFrame, day: Column, sums: dict[str, Column]) -> DataFrame:
    """(day, sums): the sums of each day's rows, added up on the map side. Rows without a day are in no window."""
    return rows.withColumn("__day", day).filter("__day IS NOT NULL").groupBy(F.col("__day").cast("date").alias("day")).agg(*[c.alias(n) for n, c in sums.items()])


def replaced(parts: DataFrame, rerun: DataFrame) -> DataFrame:
    """The parts after days were computed anew: those days' rows give way. A day whose rerun has no rows stays, so pass one of zeros."""
    return parts.join(rerun.select("day").distinct(), "day", "left_anti").unionByName(rerun)


def running(parts: DataFrame, names: Sequence[str]) -> DataFrame:
    """(day, names): sums of all days so far. One row a day goes through the window, whatever the rows behind them."""
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return parts.select("day", *[F.sum(n).over(so_far).alias(n) for n in names])


def windows(parts: DataFrame, as_of: Column, spans: dict[str, tuple[int, int]], names: Sequence[str]) -> DataFrame:
    """One row with a struct of sums for each window: a span (back, to) has the days from `back` - 1 days before as_of up to `to` days
    before it, so (7, 0) is the week that ends with as_of's day."""
    all_ = F.struct(*[F.col(n) for n in names])

    def upto(days: int) -> Column:
        return F.max_by(all_, F.when(F.col("day") <= F.date_sub(as_of, days), F.col("day")))

    edges = sorted({d for span in spans.values() for d in span})
    found = running(parts, names).agg(*[upto(d).alias(f"__{d}") for d in edges])
    zero = lambda days, n: F.coalesce(F.col(f"__{days}.{n}"), F.lit(0))
    return found.select(*[F.struct(*[(zero(to, n) - zero(back, n)).alias(n) for n in names]).alias(w) for w, (back, to) in spans.items()])

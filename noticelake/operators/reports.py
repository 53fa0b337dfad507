"""Reports: coverage, weekly change, acceptance, upcoming dates, counts, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import percentage
from ..functions.text import html_escape

# What events are called.
EVENT_LABELS = {"new": "New tender", "amendment": "Amendment posted", "close_date_changed": "Close date changed", "new_attachment": "New attachment"}
RATES = ("coverage_rate", "signal_rate", "low_signal_rate")


def coverage(df: DataFrame) -> DataFrame:
    """One row of counts and rates over rows with flags: has_attachment, has_signal, has_requirement, has_date, low_signal and counts: summaries, failures."""
    count = lambda c: F.count_if(F.col(c))
    out = df.agg(
        F.count("*").alias("notices"), count("has_attachment").alias("with_attachment"), count("has_signal").alias("with_signal"), count("has_requirement").alias("with_requirement"),
        count("has_date").alias("with_date"), F.coalesce(F.sum("summaries"), F.lit(0)).alias("summaries"), F.coalesce(F.sum("failures"), F.lit(0)).alias("failures"), count("low_signal").alias("low_signals"),
    )
    return out.withColumns({"coverage_rate": percentage(F.col("with_signal"), F.col("notices")), "signal_rate": percentage(F.col("with_signal"), F.col("with_attachment")), "low_signal_rate": percentage(F.col("low_signals"), F.col("with_attachment"))})


def weekly_delta(now: DataFrame, before: DataFrame, metrics: Sequence[str] = RATES) -> DataFrame:
    """(metric, current, previous, delta) from two one-row coverage frames."""
    tall = lambda df, to: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(to)) for m in metrics])).alias("x")).select("x.*")
    return tall(now, "current").join(tall(before, "previous"), "metric", "left").withColumn("previous", F.coalesce("previous", F.lit(0.0))).withColumn("delta", F.round(F.col("current") - F.col("previous"), 2))


def between(df: DataFrame, at: str, as_of: Column, days_back: int, days_to: int = 0) -> DataFrame:
    """Rows of a half-open window of days before as_of."""
    return df.filter((F.col(at) >= as_of - F.make_dt_interval(F.lit(days_back))) & (F.col(at) < as_of - F.make_dt_interval(F.lit(days_to))))


def upcoming(df: DataFrame, close: str, as_of: Column, days: int = 7, most: int = 15, tie: str = "key") -> DataFrame:
    """What closes within so many days, soonest first."""
    left = (F.unix_timestamp(close) - F.unix_timestamp(as_of)) / 86400
    return df.filter((left >= 0) & (left <= days)).withColumn("days_left", F.floor(left)).orderBy(close, tie).limit(most)


def counts_by_date(df: DataFrame, at: str) -> DataFrame:
    return df.filter(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("date")).agg(F.count("*").alias("rows"))


def searched(df: DataFrame, words: str, columns: Sequence[str], least: float | None = None, most: float | None = None, score: str = "score", at: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows that hold the words in any column, any case, within a score range and an inclusive date range; no upper score by default."""
    found = F.lit(words == "")
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(words.lower()))
    out = df.filter(found)
    if least is not None:
        out = out.filter(F.col(score) >= least)
    if most is not None:
        out = out.filter(F.col(score) <= most)
    if at is not None and start is not None:
        out = out.filter(F.to_date(at) >= start)
    if at is not None and end is not None:
        out = out.filter(F.to_date(at) <= end)
    return out


def capped(df: DataFrame, group: str, key: str, order: Sequence[str], per_group: int, total: int) -> DataFrame:
    """The first rows of each (key, group) up to per_group, then of each key up to total."""
    a = df.withColumn("__n", F.row_number().over(Window.partitionBy(key, group).orderBy(*order))).filter(F.col("__n") <= per_group)
    return a.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(group, *order))).filter(F.col("__n") <= total).withColumnRenamed("__n", "place")


def event_labels(events: Column) -> Column:
    names = F.create_map(*[F.lit(x) for p in EVENT_LABELS.items() for x in p])
    return F.array_join(F.transform(events, lambda e: F.coalesce(F.element_at(names, e), e)), "; ")


def digest_rows(df: DataFrame) -> DataFrame:
    """(section, html): escaped rows, in sections: new, updated."""
    section = F.when(F.array_contains("events", "new"), "new").otherwise("updated")
    cell = lambda c: F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))
    return df.select("key", section.alias("section"), F.concat(F.lit("<tr>"), cell("title"), cell("score"), F.lit("<td>"), html_escape(event_labels(F.col("events"))), F.lit("</td></tr>")).alias("html"))


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays are joined, structs become JSON; one header line in each file."""
    flat = [F.array_join(F.col(c).cast("array<string>"), "; ").alias(c) if t.startswith("array<string") else F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def experiment_summary(df: DataFrame, arm: str) -> DataFrame:
    """By arm: rows, rows with a signal, mean numbers of requirements and dates."""
    return df.groupBy(arm).agg(F.count("*").alias("rows"), F.count_if("has_signal").alias("with_signal"), F.round(F.avg("n_requirements"), 2).alias("mean_requirements"), F.round(F.avg("n_dates"), 2).alias("mean_dates"))

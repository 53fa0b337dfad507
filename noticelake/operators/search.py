"""Search in columns of text by an index of trigrams: postings are intersected, what is left is verified."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands twice at either end of a text, so that one or two characters, too, are part of a trigram.
EDGE = "\u0002"


def folded(x: Column) -> Column:
    return F.lower(F.coalesce(x.cast("string"), F.lit("")))


def trigrams(x: Column) -> Column:
    """The distinct trigrams of a text in lower case, with its ends marked."""
    marked = F.concat(F.lit(EDGE * 2), folded(x), F.lit(EDGE * 2))
    return F.array_distinct(F.regexp_extract_all(marked, F.lit("(?s)(?=(...))"), F.lit(1)))


def write_postings(df: DataFrame, key: str, columns: Sequence[str], path: str, files: int = 16) -> None:
    """The table (gram, key) of the columns' trigrams, sorted by gram in files by ranges of grams, so a reader's filter on grams skips
    files and row groups by their statistics. A gram that all rows hold is spread over files by key."""
    grams = F.array_distinct(F.flatten(F.array(*[trigrams(F.col(c)) for c in columns])))
    rows = df.select(F.explode(grams).alias("gram"), F.col(key).alias("key"))
    rows.repartitionByRange(files, "gram", "key").sortWithinPartitions("gram", "key").write.mode("overwrite").parquet(path)


def candidates(spark: SparkSession, path: str, words: str) -> DataFrame:
    """(key): rows that hold every trigram of the words in some column, by the postings of these alone; with fewer than three
    characters, rows that hold a trigram with them."""
    low = words.lower()
    postings = spark.read.parquet(path)
    if len(low) < 3:
        return postings.filter(F.contains("gram", F.lit(low))).select("key").distinct()
    grams = sorted({low[k : k + 3] for k in range(len(low) - 2)})
    return postings.filter(F.col("gram").isin(grams)).groupBy("key").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams)).select("key")


def found(df: DataFrame, key: str, columns: Sequence[str], path: str, words: str) -> DataFrame:
    """The rows that hold the words in any of the columns, any case, as a scan finds them; all rows for no words. Grams may come
    from places apart or from several columns, so candidates are verified."""
    if not words:
        return df
    holds = F.lit(False)
    for c in columns:
        holds = holds | F.contains(folded(F.col(c)), F.lit(words.lower()))
    keys = candidates(df.sparkSession, path, words).withColumnRenamed("key", "__key")
    return df.join(keys, df[key] == F.col("__key"), "left_semi").filter(holds)

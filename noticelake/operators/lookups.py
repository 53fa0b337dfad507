"""Cache lookups as joins: by server metadata, by content, by the first of several keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import normalize_etag


def newest(cache: DataFrame, by: Sequence[str], at: str, tie: str) -> DataFrame:
    """The newest row of each combination of `by` (nulls are values)."""
    order = Window.partitionBy(*by).orderBy(F.col(at).desc_nulls_last(), tie)
    return cache.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def cached_by_meta(items: DataFrame, cache: DataFrame, at: str = "fetched_at", tie: str = "fingerprint") -> DataFrame:
    """items with the newest cache row of equal url, etag and last_modified (null equals null), else of equal url and content.

    Adds fingerprint and found_by (meta, content or null).
    """
    meta = newest(cache, ["url", "etag", "last_modified"], at, tie).select(F.col("url").alias("m_url"), F.col("etag").alias("m_etag"), F.col("last_modified").alias("m_modified"), F.col(tie).alias("m_tie"))
    body = newest(cache.filter("content_hash IS NOT NULL"), ["url", "content_hash"], at, tie).select(F.col("url").alias("c_url"), F.col("content_hash").alias("c_hash"), F.col(tie).alias("c_tie"))
    out = items.join(meta, (items["url"] == meta["m_url"]) & items["etag"].eqNullSafe(meta["m_etag"]) & items["last_modified"].eqNullSafe(meta["m_modified"]), "left")
    out = out.join(body, (items["url"] == body["c_url"]) & (items["content_hash"] == body["c_hash"]), "left")
    found = F.when(F.col("m_tie").isNotNull(), "meta").when(F.col("c_tie").isNotNull(), "content")
    return out.select(*items.columns, F.coalesce("m_tie", "c_tie").alias(tie), found.alias("found_by"))


def split_by_cache(items: DataFrame, cache: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Items that the cache has and items that it lacks."""
    known = cache.select(*keys).distinct()
    return items.join(known, list(keys), "left_semi"), items.join(known, list(keys), "left_anti")


def first_key_lookup(items: DataFrame, cache: DataFrame, candidates: Sequence[str], cache_key: str, value: str) -> DataFrame:
    """items with the value cached under the first of its candidate keys that the cache has. Of several values of a key the smallest
    counts, so no item comes twice."""
    out, found = items, []
    for k, c in enumerate(candidates):
        one = cache.groupBy(F.col(cache_key).alias(f"__k{k}")).agg(F.min(value).alias(f"__v{k}"))
        out = out.join(one, F.col(c) == F.col(f"__k{k}"), "left")
        found.append(F.col(f"__v{k}"))
    return out.select(*items.columns, F.coalesce(*found).alias(value))


def seen_between(df: DataFrame, at: str, start: Column, end: Column) -> DataFrame:
    """Rows seen from start to end, both included; pushed down to the scan where both are literals. Rows never seen are out."""
    return df.filter(F.col(at).between(start, end))


def with_review(items: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """items with `reviewed`: whether there is a mark for their key, however many."""
    marked = marks.select(F.col(key).alias("__key")).distinct().withColumn("__marked", F.lit(True))
    return items.join(marked, F.col(key) == F.col("__key"), "left").withColumn("reviewed", F.coalesce("__marked", F.lit(False))).drop("__key", "__marked")


def rows_with_text(cache: DataFrame, least_chars: int, most: int, tie: str = "fingerprint") -> DataFrame:
    """A sample of the newest cache rows with a text of some length."""
    return cache.filter(F.col("text_path").isNotNull() & (F.coalesce("text_chars", F.lit(0)) >= least_chars)).orderBy(F.col("fetched_at").desc_nulls_last(), tie).limit(most)


def random_rows(df: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """A random sample of a fixed size, the same for the same seed: the rows with the smallest hashes of seed and key."""
    return df.withColumn("__place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("__place", key).limit(most).drop("__place")


def with_payload(rows: DataFrame, stored: DataFrame, keys: Sequence[str], stored_key: str = "tender_key", payload: str = "payload") -> DataFrame:
    """Exported rows with the payload stored under the first of their keys that is known."""
    return first_key_lookup(rows, stored, keys, stored_key, payload)


def fetch_plan(items: DataFrame, cache: DataFrame) -> DataFrame:
    """items (url and what the server tells: etag, last_modified) with what to do: reuse where the newest cached copy has the same
    etag (or, without one, the same last_modified), download else; and the validators to ask with."""
    last = newest(cache, ["url"], "fetched_at", "fingerprint").select(F.col("url").alias("__url"), normalize_etag(F.col("etag")).alias("if_none_match"), F.col("last_modified").alias("if_modified_since"), F.col("fingerprint").alias("cached"))
    out = items.join(last, items["url"] == F.col("__url"), "left").drop("__url")
    told = F.nullif(normalize_etag(F.col("etag")), F.lit(""))
    same = F.when(told.isNotNull(), told == F.col("if_none_match")).otherwise(F.col("last_modified") == F.col("if_modified_since"))
    return out.withColumn("action", F.when(F.coalesce(same, F.lit(False)), "reuse").otherwise("download"))

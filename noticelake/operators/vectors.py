"""Rows against a few intent vectors or keyword sets: best match, scores, centroids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import cosine, norm
from ..functions.text import blank, let, soft_normalize

#: Buckets beyond which best_bucket refuses to broadcast.
MOST_BUCKETS = 1000

# Intent buckets with their keywords.
BUCKET_KEYWORDS = {
    "ERP modernization": ["enterprise resource planning", "erp modernization", "erp migration", "erp replacement", "s/4hana", "sap ecc", "financial system replacement", "general ledger", "accounts payable", "accounts receivable"],
    "Procurement": ["procure-to-pay", "source-to-pay", "e-procurement", "procurement system", "supplier management", "ariba", "sap business network", "supply chain management"],
    "HR/payroll": ["human capital management", "hcm", "hris", "payroll system", "pension payroll", "successfactors", "workday"],
    "Integration/data": ["system integration", "integration services", "middleware", "sap cpi", "api integration", "data migration", "data conversion", "master data", "sap btp"],
    "AMS": ["application managed services", "ams", "sap support", "production support", "maintenance services", "basis support", "managed services"],
}


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): component-wise means. Components are summed on the map side, so only labels times length rows move."""
    parts = df.select(label, F.posexplode(vector).alias("at", "x")).groupBy(label, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("centroid"))


def best_match(vector: Column, buckets: DataFrame, name: str, bucket_vector: str) -> Column:
    """struct<bucket, similarity>: the bucket of largest cosine; the first by name where equal, unknown where none is above 0.

    Buckets are a short list (at most MOST_BUCKETS, counted): made unit vectors here, once, they ride along as one literal array of
    each row, so there is no join and no shuffle; a row's own length is computed once.
    """
    listed = buckets.select(F.col(name).cast("string").alias("name"), F.col(bucket_vector).cast("array<double>").alias("v")).orderBy("name").limit(MOST_BUCKETS + 1).collect()
    if len(listed) > MOST_BUCKETS:
        raise ValueError(f"more than {MOST_BUCKETS} buckets")
    if not listed:
        return F.struct(F.lit("unknown").alias("bucket"), F.lit(0.0).alias("similarity"))

    def against(x: Column) -> Column:
        size = F.greatest(norm(x), F.lit(5e-324))
        known = F.array(*[F.struct(cosine_to(x, size, [float(c) for c in b["v"] or ()]).alias("similarity"), F.lit(-k).alias("turn"), F.lit(b["name"]).alias("name")) for k, b in enumerate(listed)])
        return let(F.array_max(known), lambda b: F.struct(F.when(b["similarity"] > 0, b["name"]).otherwise("unknown").alias("bucket"), b["similarity"].alias("similarity")))

    return let(F.coalesce(vector.cast("array<double>"), F.array().cast("array<double>")), against)


def cosine_to(x: Column, size: Column, bucket: list[float]) -> Column:
    """Cosine of x, whose length is size, and a bucket, clamped to 0..1; 0 for empty or zero vectors. Where lengths differ, the
    shorter decides, as in numbers.cosine."""
    length = math.sqrt(sum(c * c for c in bucket))
    if length == 0:
        return F.lit(0.0)
    product = F.aggregate(F.zip_with(x, F.array(*[F.lit(c) for c in bucket]), lambda p, q: p * q), F.lit(0.0), lambda t, p: t + p)
    even = F.when(product > 0, F.least(F.lit(1.0), product / (size * length))).otherwise(F.lit(0.0))
    return F.when(F.size(x) == len(bucket), even).when(F.size(x) == 0, F.lit(0.0)).otherwise(cosine(x, F.array(*[F.lit(c) for c in bucket])))


def best_bucket(df: DataFrame, key: str, vector: str, buckets: DataFrame, name: str, bucket_vector: str) -> DataFrame:
    """(key, bucket, similarity), see best_match."""
    return df.select(key, F.inline(F.array(best_match(F.col(vector), buckets, name, bucket_vector))))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_vector(x: Column) -> Column:
    """How often each letter a-z stands in a text: a stand-in for the embeddings of a model, none of which is reachable here."""
    return let(F.lower(blank(x)), lambda t: F.array(*[(F.char_length(t) - F.char_length(F.replace(t, F.lit(c), F.lit("")))).cast("double") for c in LETTERS]))


def keyword_similarity(text: Column, keywords: list[str]) -> Column:
    """Share of the keywords that the text holds."""
    return F.size(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(text, k))) / F.lit(len(keywords))


def best_keywords(text: Column, buckets: dict[str, list[str]]) -> Column:
    """struct<similarity, bucket>: the bucket with the largest share of keywords found, the first where equal."""

    def known(x: Column) -> Column:
        return F.array_max(F.array(*[F.struct(keyword_similarity(x, words).alias("similarity"), F.lit(-k).alias("turn"), F.lit(name).alias("bucket")) for k, (name, words) in enumerate(buckets.items())]))

    return let(let(text, known), lambda best: F.struct(best["similarity"].alias("similarity"), F.when(best["similarity"] > 0, best["bucket"]).otherwise("unknown").alias("bucket")))


def unit(vector: Column) -> Column:
    length = norm(vector)
    return F.when(length > 0, F.transform(vector, lambda x: x / length)).otherwise(vector)


def bucket_text(name: Column, description: Column, keywords: Column, prototypes: Column) -> Column:
    """What is embedded of a bucket: all it says, normalised."""
    words = lambda x: F.array_join(F.coalesce(x, F.array().cast("array<string>")), " ")
    part = lambda x: F.nullif(x, F.lit(""))
    return soft_normalize(F.concat_ws(" ", part(name), part(description), part(words(keywords)), part(words(prototypes))))


#: Forms that a reply with embeddings may have.
REPLIES = ("embeddings struct<float:array<array<double>>>", "embeddings array<array<double>>", "data array<struct<embedding:array<double>>>")


def reply_vectors(reply: Column) -> Column:
    """The vectors of a service's reply (JSON), in order, whichever form it has; empty if none fits."""
    read = [F.from_json(reply, form) for form in REPLIES]
    found = (read[0]["embeddings"]["float"], read[1]["embeddings"], F.transform(read[2]["data"], lambda d: d["embedding"]))
    filled = [F.when(F.exists(f, lambda v: v.isNotNull()), f) for f in found]
    return F.coalesce(*filled, F.array().cast("array<array<double>>"))


def embedded(batches: DataFrame, keys: str, reply: str) -> DataFrame:
    """(key, vector): the keys of each request with the vectors of its reply, by place; keys without a vector are left out."""
    pairs = F.arrays_zip(F.col(keys).alias("key"), reply_vectors(F.col(reply)).alias("vector"))
    return batches.select(F.explode(pairs).alias("p")).select("p.key", "p.vector").filter("key IS NOT NULL AND vector IS NOT NULL")

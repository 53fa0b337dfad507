"""The corpus pipeline: quality rules, near duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents; the last
returns packed pieces. Rejected and duplicate documents leave, frequent lines and personal data are taken out of the texts,
and the mix repeats a document as often as it takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm import jaccard, mixing, packing, pii, quality
from noticelake.llm.common import join_on, looked_up, materialize, sheltered, small_enough
from noticelake.llm.queries import tokenizer_path

#: Documents up to which a stage's list of decisions is broadcast rather than joined by shuffle.
MOST_BROADCAST = 1_000_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.apply_quality(docs, quality.quality_rules(docs), most_broadcast=MOST_BROADCAST)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word shingles of five words, similarity of 0.8 or more; the smallest doc_id of each group stays."""
    return jaccard.one_of_each(docs, width=5, percent=80, least_broadcast=MOST_BROADCAST)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_documents(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return sheltered(docs, mixed)


def mixed(docs: DataFrame) -> DataFrame:
    """Documents taken once, the common case, need not be looked up."""
    key = ["doc_id", "__key", "source"]
    taken = mixing.mix_sources(docs).withColumnRenamed("text_key", "__key").groupBy(*key).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    other = looked_up(taken.filter("__copies <> 1 OR __rows > 1"), "copies", MOST_BROADCAST)
    keyed = join_on(docs.withColumn("__key", F.xxhash64("text")), other, key, "left")
    if not small_enough(other.filter("__rows > 1"), 0):  # equal rows: one of them as often as the mix takes them together
        single = F.coalesce("__rows", F.lit(1)) == 1
        keyed = keyed.filter(single).unionByName(keyed.filter(~single).dropDuplicates(key))
    times = F.coalesce("__copies", F.lit(1)).cast("int")
    return keyed.withColumn("__time", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("personal data", personal_data_stage),
    ("source mix", mix_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the stages (fingerprints, tokens); tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs

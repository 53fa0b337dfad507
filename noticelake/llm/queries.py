"""The registered queries of the operators, one opN_<name> each: production parameters, whole tables, contract columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import spread
from . import align, ann, chat, codebooks, fixity, jaccard, license, mixing, packing, pii, quality, repeats, sql, wavelet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one over all cores, as what follows costs more than a shuffle of it."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents")).drop("scored")


def op6_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to archives and a replica of those on storage that decays (a drill), and audits the replica's files against ours."""
    return fixity.audit(*fixity.archived(table(spark, sf_dir, "pages"), fixity.decayed)).select("page_id", "url", "length", "digest", "copy_digest", "status")


def op7_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digest_conversations(chat.format_conversations(chat.turn_events(stored.unionByName(added))))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), width=3, percent=90)


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids to shards and reads the shards back."""
    return wavelet.read_documents(wavelet.write_shards(table(spark, sf_dir, "documents"), tokenizer_path()))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.encode_vectors(table(spark, sf_dir, "embeddings")).drop("label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_license_scan": op2_license_scan,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_source_mix": op4_source_mix,
        "op5_personal_data": op5_personal_data,
        "op6_merkle_fixity": op6_merkle_fixity,
        "op7_repeated_substrings": op7_repeated_substrings,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_nearest_vectors": op10_nearest_vectors,
        "op11_wavelet_shards": op11_wavelet_shards,
        "op12_token_alignment": op12_token_alignment,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()

"""From source rows to normalised notices, in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_timestamp
from ..functions.text import blank, first_nonempty, repair_mojibake
from ..functions.urls import best_url, extract_urls

# Bilingual column names of the source, by field.
SOURCE_COLUMNS = {
    "title_en": "title-titre-eng", "title_fr": "title-titre-fra", "ref": "referenceNumber-numeroReference", "amendment_number": "amendmentNumber-numeroModification",
    "solicitation_number": "solicitationNumber-numeroSollicitation", "published": "publicationDate-datePublication", "closing": "tenderClosingDate-appelOffresDateCloture",
    "amended": "amendmentDate-dateModification", "status_en": "tenderStatus-appelOffresStatut-eng", "status_fr": "tenderStatus-appelOffresStatut-fra", "gsin": "gsin-nibs",
    "gsin_desc_en": "gsinDescription-nibsDescription-eng", "gsin_desc_fr": "gsinDescription-nibsDescription-fra", "unspsc": "unspsc",
    "unspsc_desc_en": "unspscDescription-eng", "unspsc_desc_fr": "unspscDescription-fra", "procurement_category": "procurementCategory-categorieApprovisionnement",
    "notice_type_en": "noticeType-avisType-eng", "notice_type_fr": "noticeType-avisType-fra", "proc_method_en": "procurementMethod-methodeApprovisionnement-eng",
    "proc_method_fr": "procurementMethod-methodeApprovisionnement-fra", "org_en": "contractingEntityName-nomEntitContractante-eng",
    "org_fr": "contractingEntityName-nomEntitContractante-fra", "url_en": "noticeURL-URLavis-eng", "url_fr": "noticeURL-URLavis-fra",
    "attachments": "attachment-piecesJointes-eng", "description_en": "tenderDescription-descriptionAppelOffres-eng", "description_fr": "tenderDescription-descriptionAppelOffres-fra",
}


def parse_codes(x: Column) -> Column:
    """Starred, line-separated codes as digits."""
    parts = F.transform(F.split(blank(x), r"[\n\r]+|\*"), lambda p: F.regexp_replace(p, "[^0-9]", ""))
    return F.filter(parts, lambda p: p != "")


def stable_key(uid: Column, source: Column, *bases: Column) -> Column:
    """uid up to its last ':am'; else source and the first known base."""
    cut = F.regexp_replace(blank(uid), ":am(?!.*:am).*$", "")
    return F.when(cut != "", cut).otherwise(F.concat(source, F.lit(":"), first_nonempty(*bases)))


def inferred_key(df: DataFrame) -> Column:
    """tender_key, from uid, from source and id / solicitation / url, else a hash of the row."""
    have = lambda c: F.nullif(F.trim(blank(F.col(c))), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    base = F.coalesce(have("id"), have("solicitation_number"), have("url"))
    cut = F.nullif(F.regexp_replace(have("uid"), ":am(?!.*:am).*$", ""), F.lit(""))
    return F.coalesce(have("tender_key"), cut, F.when(base.isNotNull(), F.concat(F.coalesce(have("source"), F.lit("unknown")), F.lit(":"), base)), F.substring(F.sha2(F.to_json(F.struct(*df.columns)), 256), 1, 16))


def amendment(x: Column) -> Column:
    return F.trim(x.cast("string")).try_cast("int")


def attachment_hash(urls: Column) -> Column:
    """Of the set of links: trimmed, each once, in order; empty for none."""
    links = F.array_sort(F.array_distinct(F.filter(F.transform(urls, lambda u: F.trim(u)), lambda u: u != "")))
    return F.when(F.coalesce(F.size(links), F.lit(0)) > 0, F.sha2(F.to_json(links), 256)).otherwise(F.lit(""))


def is_open(df: DataFrame) -> DataFrame:
    return df.filter((F.lower(F.trim(blank(F.col("status_en")))) == "open") | (F.lower(F.trim(blank(F.col("status_fr")))) == "ouvert"))


def normalize(rows: DataFrame, source: str = "notices") -> DataFrame:
    """Source rows (any of SOURCE_COLUMNS; others are ignored) to notices. Missing text is empty; bad dates are null."""
    raw = lambda f: repair_mojibake(F.trim(blank(F.col(f"`{SOURCE_COLUMNS[f]}`")))) if SOURCE_COLUMNS[f] in rows.columns else F.lit("")
    a = rows.select(*[raw(f).alias(f) for f in SOURCE_COLUMNS])
    a = a.withColumns({"publish_at": parse_timestamp(F.col("published")), "amend_at": parse_timestamp(F.col("amended")), "close_at": parse_timestamp(F.col("closing"))})
    url = best_url(F.col("url_en"), F.col("url_fr"), F.col("attachments"))
    a = a.withColumns(
        {
            "source": F.lit(source),
            "title": first_nonempty(F.col("title_en"), F.col("title_fr")),
            "description": first_nonempty(F.col("description_en"), F.col("description_fr")),
            "org": first_nonempty(F.col("org_en"), F.col("org_fr")),
            "url": url,
            "unspsc": parse_codes(F.col("unspsc")),
            "gsin": F.filter(F.split(F.replace(F.col("gsin"), F.lit("*"), F.lit("")), r"[\n\r]+"), lambda p: F.trim(p) != ""),
            "attachments": F.when(F.col("attachments") != "", extract_urls(F.col("attachments"))).otherwise(F.array().cast("array<string>")),
            "updated_at": F.greatest("publish_at", "amend_at"),
        }
    )
    am = F.when(F.col("amendment_number") != "", F.col("amendment_number")).otherwise("000")
    uid = F.when(F.col("ref") != "", F.concat_ws(":", F.lit(source), F.col("ref"), F.concat(F.lit("am"), am))).otherwise(F.col("url"))
    a = a.withColumn("uid", uid)
    return a.withColumns({"tender_key": stable_key(F.when(F.col("ref") != "", F.col("uid")), F.lit(source), F.col("ref"), F.col("solicitation_number"), F.col("url")), "attachment_hash": attachment_hash(F.col("attachments"))})

"""The rule cascade: term hits, reasons for rejection in order, scores, rationale."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import evidence_score, semantic_score
from ..functions.rows import spread
from ..functions.text import blank, listed, normalize_text, once
from ..plans import terms as T

# Reasons for rejection, in the order in which they are tried.
REASONS = (
    "exclude_award_notice", "exclude_supply_arrangement", "exclude_staffing", "exclude_negative_title", "exclude_non_it_unspsc", "exclude_goods_or_hardware",
    "exclude_no_erp_domain", "exclude_no_transformation", "exclude_no_it_context", "exclude_far_future_close",
)


@dataclass(frozen=True)
class RuleConfig:
    terms: dict = field(default_factory=lambda: T.NOTICE_TERMS)
    staffing_patterns: tuple = tuple(T.STAFFING_PATTERNS)
    portal_words: tuple = ("sap", "ariba")
    include_supply: bool = False
    include_staffing: bool = False
    max_close_days: int = 180
    min_score: int = 70


# The fields of a notice that rules read, in order.
BLOB = ("title", "title_en", "title_fr", "description", "description_en", "description_fr", "unspsc_desc_en", "unspsc_desc_fr", "gsin_desc_en", "gsin_desc_fr", "notice_type_en", "notice_type_fr", "procurement_category")


def raw_blob(df: DataFrame) -> Column:
    """The language and classification columns that df has, joined."""
    return F.concat_ws(" ", *[F.nullif(blank(F.col(c)), F.lit("")) for c in BLOB if c in df.columns])


def text_blob(df: DataFrame) -> Column:
    return normalize_text(raw_blob(df))


def code_starts(codes: Column, prefixes: list[str]) -> Column:
    return F.exists(codes, lambda c: c.rlike("^(?:" + "|".join(prefixes) + ")"))


IN_TEXT = ("direct", "domain", "transform", "it", "portal", "supply", "hardware")
IN_TITLE = ("allow_title", "allow_product", "negative")


def rule_hits(df: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """Adds __title, __type and the hits of each dictionary; the text and the title are each read once for all terms."""
    df = spread(df)
    told = lambda names: {k: config.terms[k] for k in names}
    out = df.withColumns({"__in_text": T.scan(raw_blob(df), told(IN_TEXT)), "__in_title": T.scan(F.col("title"), told(IN_TITLE))})
    hits = {f"{k}_hits": F.col(f"__in_text.{k}") for k in IN_TEXT} | {f"{k}_hits": F.col(f"__in_title.{k}") for k in IN_TITLE}
    kind = normalize_text(F.coalesce(F.nullif(blank(F.col("notice_type_en")), F.lit("")), blank(F.col("notice_type_fr"))))
    return once(out, hits | {"__title": F.col("__in_title.norm"), "__type": kind}).drop("__in_text", "__in_title")


def is_direct(config: RuleConfig) -> Column:
    """A direct hit counts unless it is only a portal's name: nothing but those words, none in the title, no allow-listed title, and portal wording or no other context."""
    words = F.array(*[F.lit(w) for w in config.portal_words])
    weak = F.size(F.array_except("direct_hits", words)) == 0
    titled = F.lit(False)
    for w in config.portal_words:
        titled = titled | F.contains("__title", F.lit(w))
    allowed = (F.size("allow_title_hits") > 0) | (F.size("allow_product_hits") > 0)
    bare = (F.size("portal_hits") > 0) | ((F.size("domain_hits") == 0) & (F.size("it_hits") == 0))
    return (F.size("direct_hits") > 0) & ~(weak & ~titled & ~allowed & bare)


def reject_reasons(config: RuleConfig, as_of: Column) -> Column:
    """All reasons of a row, in order; as_of is a parameter, so reruns agree."""
    terms, title, kind = config.terms, F.col("__title"), F.col("__type")
    direct, it_code = F.col("is_direct"), F.col("it_code")
    allowed = (F.size("allow_title_hits") > 0) | (F.size("allow_product_hits") > 0)
    some = lambda k: F.size(f"{k}_hits") > 0
    information = F.contains(kind, F.lit("request for information")) | F.contains(kind, F.lit("demande de renseignements"))
    against = F.contains(kind, F.lit("rfp against supply arrangement")) | F.contains(kind, F.lit("decoulant d'un arrangement en matiere d'approvisionnement"))
    days = F.floor((F.unix_timestamp("close_at") - F.unix_timestamp(as_of)) / 86400)
    checks = {
        "exclude_award_notice": T.any_of(kind, terms["award"]) | T.found_in(title, [r"^(?:acan|pac)\b"]),
        "exclude_supply_arrangement": F.lit(not config.include_supply) & some("supply") & ~against,
        "exclude_staffing": ~direct & F.lit(not config.include_staffing) & T.found_in(title, config.staffing_patterns),
        "exclude_negative_title": ~direct & some("negative") & ~allowed,
        "exclude_non_it_unspsc": ~direct & code_starts(F.col("unspsc"), T.NON_IT_PREFIXES),
        "exclude_goods_or_hardware": ~direct & (F.contains(F.upper(blank(F.col("procurement_category"))), F.lit("GD")) | some("hardware")),
        "exclude_no_erp_domain": ~direct & ~some("domain") & ~allowed & ~(some("transform") & (it_code | some("it"))),
        "exclude_no_transformation": ~direct & ~some("transform") & ~information & ~allowed,
        "exclude_no_it_context": ~direct & ~it_code & ~some("it") & ~allowed,
        "exclude_far_future_close": ~direct & F.coalesce(days > config.max_close_days, F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(checks[r], F.lit(r)) for r in REASONS]))


def rule_score() -> Column:
    n = lambda k: F.size(f"{k}_hits")
    direct = 100 + F.least(F.lit(20), 5 * F.greatest(n("direct") - 1, F.lit(0)))
    other = 55 + F.when(F.col("it_code"), 15).otherwise(0) + F.least(F.lit(20), 7 * n("domain")) + F.least(F.lit(15), 5 * n("transform")) + F.least(F.lit(10), 4 * n("it"))
    return F.when(F.col("is_direct"), direct).otherwise(F.least(F.lit(95), other))


def cascade(df: DataFrame, as_of: Column, config: RuleConfig = RuleConfig()) -> DataFrame:
    """df with hits, is_direct, it_code, reject_reasons, reject_reason (the first, null if none) and rule_score.

    df has title, notice_type_en, notice_type_fr, procurement_category, unspsc (array), close_at (timestamp) and any of BLOB.
    """
    out = rule_hits(df, config).withColumn("unspsc", F.coalesce("unspsc", F.array().cast("array<string>")))
    out = once(out, {"is_direct": is_direct(config), "it_code": code_starts(F.col("unspsc"), T.IT_PREFIXES) | F.exists("unspsc", lambda c: c.isin(T.IT_CODES))})
    out = once(out, {"reject_reasons": reject_reasons(config, as_of), "rule_score": rule_score()})
    return out.withColumn("reject_reason", F.get("reject_reasons", F.lit(0)))


def final_score(df: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """From rule_score and semantic_score (null: none): score, and the threshold as a reason of its own."""
    best = F.greatest(F.coalesce("semantic_score", "rule_score"), F.col("rule_score"))
    extra = F.least(F.lit(20), 5 * F.greatest(F.size("direct_hits") - 1, F.lit(0)))
    out = df.withColumn("score", F.when(F.col("is_direct"), F.greatest(F.lit(100), best + extra)).otherwise(best))
    low = F.col("reject_reason").isNull() & ~F.col("is_direct") & (F.col("score") < config.min_score)
    return out.withColumns({"reject_reason": F.when(low, F.lit("exclude_below_score_threshold")).otherwise(F.col("reject_reason")), "reject_reasons": F.when(low, F.array(F.lit("exclude_below_score_threshold"))).otherwise(F.col("reject_reasons"))})


def with_evidence(df: DataFrame, similarity: str = "similarity") -> DataFrame:
    """Adds evidence and semantic_score from hits and a similarity column."""
    allowed = F.size("allow_title_hits") + F.size("allow_product_hits")
    it = F.when(F.col("it_code") | (F.size("it_hits") > 0), 1).otherwise(0)
    out = df.withColumn("evidence", evidence_score(it, F.size("domain_hits"), F.size("transform_hits"), allowed))
    return out.withColumn("semantic_score", semantic_score(F.col(similarity), F.col("evidence")))


def rationale(bucket: Column, similarity: Column) -> Column:
    """What speaks for a row, in words. The labels are fixed values."""
    some = lambda k: F.size(f"{k}_hits") > 0
    part = lambda name, k: F.when(some(k), F.concat(F.lit(f"{name} ("), listed(F.col(f"{k}_hits")), F.lit(")")))
    allowed = F.concat("allow_title_hits", "allow_product_hits")
    rules = F.concat_ws(
        "; ", F.when(F.col("is_direct"), F.coalesce(part("SAP direct", "direct"), F.lit("SAP direct"))), F.when(~F.col("is_direct"), part("ERP domain", "domain")), F.when(~F.col("is_direct"), part("Transform", "transform")),
        F.when(F.col("it_code"), F.lit("UNSPSC IT")), F.when(F.size(allowed) > 0, F.concat(F.lit("Allowlist ("), listed(allowed, 2), F.lit(")"))),
    )
    meaning = F.when(bucket != "unknown", F.concat(F.lit("Semantic: "), bucket, F.coalesce(F.concat(F.lit(" (sim "), F.format_number(similarity, 2), F.lit(")")), F.lit(""))))
    return F.concat_ws(" | ", F.when(rules != "", F.concat(F.lit("Rules: "), rules)), meaning)


def reason_counts(df: DataFrame, most: int = 15) -> DataFrame:
    """How many rows each first reason rejects, most frequent first."""
    return df.filter(F.col("reject_reason").isNotNull()).groupBy("reject_reason").agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), "reject_reason").limit(most)


def near_misses(df: DataFrame) -> DataFrame:
    return df.filter(F.size("reject_reasons") == 1)


def watchlist(df: DataFrame, order: list[Column], blocked: tuple = ("exclude_award_notice", "exclude_supply_arrangement", "exclude_staffing"), most: int = 20) -> DataFrame:
    """The first rows in order that one reason rejects, and not a blocked one."""
    return near_misses(df).filter(~F.col("reject_reason").isin(*blocked)).orderBy(*order).limit(most)


def model_gate(decided: DataFrame, key: str, order: list[Column], top: int = 10, borderline: int = 5, least_score: int = 80, most: int = 20, spent: int = 0) -> DataFrame:
    """Rows for a costly model: the top and borderline kept ones and near misses of a least score; each key once, capped at what
    is left of the day's `most` after `spent` calls. decided is read once; only the first rows of each kind leave a task.
    """
    miss = (F.size("reject_reasons") == 1) & (F.col("reject_reason") != "exclude_below_score_threshold") & (F.col("score") >= least_score)
    from_ = F.when(F.col("reject_reason").isNull(), 0).when(miss, 1)
    left = max(0, most - spent)
    placed = decided.withColumn("__from", from_).filter("__from IS NOT NULL")
    placed = placed.withColumn("__n", F.row_number().over(Window.partitionBy("__from").orderBy(*order))).filter(F.col("__n") <= max(most, top + borderline))
    placed = placed.filter((F.col("__from") == 1) | (F.col("__n") <= top + borderline))
    first = placed.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__from"))).filter("__n = 1")
    return first.orderBy("__from", *order).limit(left).drop("__n", "__from")

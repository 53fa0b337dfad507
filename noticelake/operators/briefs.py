"""Structured briefs: parsing model replies, mapping to fixed categories, grounding, confidence, notes.

No model is called here. `extractive_brief` is a deterministic stand-in with the same schema, and says so in its method field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, json_object, let, match_key, normalize_text, truncate

#: A model's reply; other forms of a field are null, and so take the defaults.
BRIEF = (
    "struct<relevance:string,opportunity_category:string,SAP_solution_fit:struct<fit:string,notes:array<string>>,key_requirements:array<string>,stakeholder_entities:struct<buyer_org:string,program_name:string,other_entities:array<string>>,"
    "timeline:struct<close_date:string,expected_start:string,milestones:array<string>,notes:string>,competitive_signals:array<string>,recommended_next_step:string>"
)

# Words that decide a category or a fit, the first that occurs in this order. (Words that a shorter one in the list
# already decides are left out; the last five are those tried when no other is found.)
CATEGORIES = {
    "erp modernization": "ERP modernization", "erp modernisation": "ERP modernization", "erp upgrade": "ERP modernization", "erp migration": "ERP modernization",
    "financial systems": "ERP modernization", "procurement": "procurement", "source to pay": "procurement", "procure to pay": "procurement", "hr": "HR/payroll", "hcm": "HR/payroll",
    "hris": "HR/payroll", "payroll": "HR/payroll", "integration": "integration/data", "data": "integration/data", "ams": "AMS", "application management": "AMS",
    "managed services": "AMS", "erp": "ERP modernization", "financial": "ERP modernization", "procure": "procurement", "supply": "procurement", "managed": "AMS",
}
FITS = {"strong": "strong", "high": "strong", "good": "strong", "moderate": "moderate", "medium": "moderate", "fair": "moderate", "weak": "weak", "low": "weak", "none": "weak"}
RELEVANCE = {"high": "high", "medium": "medium", "moderate": "medium", "med": "medium", "low": "low"}


def first_match(x: Column, words: dict[str, str], otherwise: str) -> Column:
    key, out = match_key(x), F.lit(otherwise)
    for word, name in reversed(words.items()):
        out = F.when(F.contains(key, F.lit(match_word(word))), name).otherwise(out)
    return out


def relevance(x: Column) -> Column:
    out = F.lit("medium")
    for word, name in RELEVANCE.items():
        out = F.when(F.lower(F.trim(blank(x))) == word, name).otherwise(out)
    return out


def match_word(word: str) -> str:
    return "".join(c if c.isalnum() else " " for c in word.lower()).strip()


def as_list(x: Column, most: int) -> Column:
    """Trimmed, non-empty, at most so many."""
    return F.slice(F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != ""), 1, most)


def parse_reply(reply: Column) -> Column:
    """The first JSON object of a reply as a brief; null if there is none or it cannot be read."""
    return F.from_json(json_object(reply), BRIEF)


def grounded(items: Column, text: Column) -> Column:
    """Items that the notice's text holds, as they are or in match form."""
    forms = F.struct(F.lower(blank(text)).alias("low"), match_key(text).alias("key"))
    return let(forms, lambda t: F.filter(items, lambda x: F.contains(t["low"], F.lower(x)) | F.contains(t["key"], match_key(x))))


def normalize_brief(df: DataFrame, reply: str, text: str, hinted: Column, org: Column | None = None, close: Column | None = None) -> DataFrame:
    """Adds brief: relevance, category, fit and its notes (unknown without a hint), requirements that the text holds (two at least,
    else none), stakeholders, timeline, competitive signals, next step, confidence and a summary."""
    from .summaries import brief_summary

    org, close = org if org is not None else F.lit(""), close if close is not None else F.lit("")
    out = df.withColumn("__b", parse_reply(F.col(reply)))
    found = grounded(as_list(F.col("__b.key_requirements"), 6), F.col(text))
    out = out.withColumn("__found", F.coalesce(found, F.array().cast("array<string>")))
    n, none = F.size("__found"), F.array().cast("array<string>")
    confidence = F.when(hinted & (n >= 3), "high").when(n >= 2, "medium").otherwise("low")
    who, when = F.col("__b.stakeholder_entities"), F.col("__b.timeline")
    out = out.withColumns(
        {
            "__kind": first_match(F.col("__b.opportunity_category"), CATEGORIES, "other"), "__fit": F.when(hinted, first_match(F.col("__b.SAP_solution_fit.fit"), FITS, "unknown")).otherwise("unknown"), "__sure": confidence, "__needs": F.when(n >= 2, F.col("__found")).otherwise(none),
            "__who": stakeholders(who["buyer_org"], who["program_name"], who["other_entities"], org), "__when": timeline(when["close_date"], when["expected_start"], when["milestones"], when["notes"], close), "__next": F.trim(blank(F.col("__b.recommended_next_step"))),
        }
    )
    brief = F.struct(
        relevance(F.col("__b.relevance")).alias("relevance"), F.col("__kind").alias("category"), F.col("__fit").alias("fit"), F.when(hinted, as_list(F.col("__b.SAP_solution_fit.notes"), 4)).otherwise(none).alias("fit_notes"), F.col("__needs").alias("requirements"),
        F.col("__who").alias("stakeholders"), F.col("__when").alias("timeline"), as_list(F.col("__b.competitive_signals"), 4).alias("competitive_signals"), F.col("__next").alias("next_step"), F.col("__sure").alias("confidence"),
        brief_summary(F.col("__who.buyer_org"), F.col("__kind"), F.col("__fit"), F.col("__needs"), F.col("__when.close_date"), F.col("__next"), F.col("__sure")).alias("summary"), F.lit("model").alias("method"),
    )
    return out.withColumn("brief", brief).drop("__b", "__found", "__kind", "__fit", "__sure", "__needs", "__who", "__when", "__next")


def extractive_brief(df: DataFrame, text: str, keywords: list[str]) -> DataFrame:
    """A stand-in without a model: sentences that hold a keyword become requirements, the first sentence the summary."""
    sentences = F.filter(F.transform(F.split(blank(F.col(text)), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    wanted = F.filter(sentences, lambda s: normalize_text(s).rlike("|".join(keywords)))
    brief = F.struct(F.lit("unknown").alias("category"), F.lit("unknown").alias("fit"), F.slice(wanted, 1, 6).alias("requirements"), truncate(blank(F.get(sentences, F.lit(0))), 300).alias("summary"), F.lit("extractive").alias("method"))
    return df.withColumn("brief", brief)


def cache_keys(key: Column, amendment: Column, uid: Column) -> Column:
    """Candidate keys of a cached brief, the best first."""
    return F.array_compact(F.array(F.concat(key, F.lit(":am"), F.coalesce(amendment.cast("string"), F.lit("000"))), F.nullif(blank(uid), F.lit(""))))


def gate_score(*scores: Column) -> Column:
    """The first of the values that is a number (or whole digits as text), cut to an integer; 0 if none is."""
    number = lambda x: F.when(x.cast("string").rlike(r"^-?[0-9]+(\.[0-9]+)?(E-?[0-9]+)?$"), x.cast("string").try_cast("double").cast("int"))
    return F.coalesce(*[number(s) for s in scores], F.lit(0))


def by_confidence(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("brief.confidence").alias("confidence")).agg(F.count("*").alias("briefs"))


def token_signal(text: Column, words: list[str]) -> Column:
    """Whether any word stands in the text as a token (inside a longer word does not count)."""
    return match_key(text).rlike(r"\b(?:" + "|".join(match_word(w) for w in words) + r")\b")


def stakeholders(buyer: Column, program: Column, others: Column, org: Column, most: int = 6) -> Column:
    """struct<buyer_org, program_name, other_entities>: the notice's organisation where no buyer is named; each other once, without
    the two."""
    who = F.coalesce(F.nullif(F.trim(blank(buyer)), F.lit("")), F.trim(blank(org)))
    what = F.trim(blank(program))
    names = F.transform(F.coalesce(others, F.array().cast("array<string>")), lambda n: F.trim(blank(n)))
    rest = F.array_distinct(F.filter(names, lambda n: (n != "") & (n != who) & (n != what)))
    return F.struct(who.alias("buyer_org"), what.alias("program_name"), F.slice(rest, 1, most).alias("other_entities"))


def timeline(close: Column, start: Column, milestones: Column, notes: Column, notice_close: Column) -> Column:
    """struct<close_date, expected_start, milestones, notes>: the notice's closing date where none is given; four milestones."""
    text = lambda x: F.trim(blank(x))
    return F.struct(F.coalesce(F.nullif(text(close), F.lit("")), text(notice_close)).alias("close_date"), text(start).alias("expected_start"), as_list(milestones, 4).alias("milestones"), text(notes).alias("notes"))


#: Keys that replies must have.
SUMMARY_KEYS = ("requirements", "key_risks", "dates", "attachments_used")
STRUCTURED_KEYS = ("submission", "evaluation", "scope", "deliverables", "schedule", "risks", "compliance")
BRIEF_KEYS = ("relevance", "opportunity_category", "SAP_solution_fit", "key_requirements", "stakeholder_entities", "timeline", "competitive_signals", "recommended_next_step")


def prompt_head(task: str, keys: tuple, rules: tuple) -> str:
    return "\n".join([task, "Answer with one JSON object and nothing else, with the keys: " + ", ".join(keys) + ".", *(f"- {r}" for r in rules), ""])


def asking(task: str, keys: tuple, rules: tuple, fields: dict[str, Column]) -> Column:
    """A prompt: the task, the keys of the JSON object wanted, rules, then the fields with their names."""
    return F.concat(F.lit(prompt_head(task, keys, rules)), *[F.concat(F.lit(f"{name}: "), blank(x), F.lit("\n")) for name, x in fields.items()])


def in_language(language: Column) -> Column:
    return F.when(language == "fr", F.lit("French; keep the wording of the text")).otherwise("English")


GROUNDED = ("Use only what the text says, in its words where possible.", "Leave out what it does not say; an empty list is an answer.")


CITED = ("Each item is an object with text and citations; a citation has attachment_id, section_heading, page and offsets.",)
SUMMARY_TASK = "List what a bidder must know from an attachment of a notice."
STRUCTURED_TASK = "Sort what a bidder must know from an attachment of a notice into categories."


def summary_prompt(name: Column, excerpt: Column, language: Column, strict: bool = False) -> Column:
    more = ("Prefer formats, amounts, portals and deadlines; leave out titles, contents and introductions.", "Copy cells of tables as they are.") if strict else ()
    return asking(SUMMARY_TASK, SUMMARY_KEYS, GROUNDED + more, {"language": in_language(language), "attachment": name, "text": excerpt})


def structured_prompt(name: Column, attachment: Column, excerpt: Column, language: Column) -> Column:
    return asking(STRUCTURED_TASK, STRUCTURED_KEYS, GROUNDED + CITED, {"language": in_language(language), "attachment": name, "attachment_id": attachment, "text": excerpt})


def brief_prompt(fields: dict[str, Column]) -> Column:
    return asking("Write a short brief on whether to pursue a public notice.", BRIEF_KEYS, GROUNDED, fields)


def repair_prompt(reply: Column, keys: tuple = SUMMARY_KEYS) -> Column:
    return asking("This reply is no valid JSON; give it again as valid JSON.", keys, (), {"reply": reply})

"""Items drawn from long documents: evidence, low-signal and boilerplate tests, routing, ordered merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, let, match_key, once, repair_leniently
from .evidence import supported, with_support

# Whole items that say nothing.
BOILERPLATE = [
    "title page", "table of contents", "table of content", "toc", "abstract", "cover page", "signature page", "bid form", "submission form", "proposal format",
    "proposal template", "response format", "pricing", "price schedule", "price list", "schedule of prices", "forms", "form", "glossary", "acronyms", "definitions",
    "references", "report", "introduction", "work completed", "results", "conclusion", "executive summary", "background", "overview", "purpose", "objectives", "summary",
    "methodology", "approach", "scope", "timeline", "schedule", "work plan", "project plan", "deliverables", "milestones",
]
# Beginnings of items that say nothing; names that are requirements however short.
BOILERPLATE_STARTS = ("summary", "introduction", "conclusion", "results", "background", "overview", "purpose", "objectives", "scope", "methodology", "approach", "security requirement", "appendix", "annex")
SHORT_NAMES = ("ssl", "tls", "vpn", "ssh", "ipsec", "https", "aes", "rsa", "mfa")
STANDARDS = r"\b(soc\s?1|soc\s?2|soc\s?3|iso\s?27001)\b"

# Words that route an item.
STAFFING_WORDS = ("level", "resource", "resources", "consultant", "consultants", "specialist", "analyst", "architect", "project manager", "project executive", "developer", "engineer", "tbips", "spict")
SUBMISSION_WORDS = ("submission", "submit", "bid", "response format", "proposal format", "file size", "portal", "email", "deadline", "due date", "closing date", "must be submitted", "submit via", "submit by", "response must", "proposal must")
TECHNICAL_WORDS = (
    "integration", "api", "interface", "architecture", "data", "database", "security", "performance", "availability", "scalability", "cloud", "migration", "modernization",
    "modernisation", "implementation", "deployment", "testing", "monitoring", "analytics", "reporting", "governance", "compliance", "privacy", "backup", "disaster recovery",
    "resilience", "encryption", "authentication", "authorization", "identity", "access", "network", "hosting", "storage", "etl", "integration platform", "sensing", "risk",
    "mapping", "modernization plan",
)


def has_evidence(item: Column, evidence: Column) -> Column:
    """Whether the evidence holds the item, a date of it, or two (all, if fewer) of its tokens of four characters or more. For many
    items of one text, ask for all at once (evidence.supported)."""
    return F.get(supported(F.array(item), evidence), F.lit(0))


def word_list(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("[A-Za-z0-9]+"), F.lit(0))


def is_boilerplate(item: Column) -> Column:
    """Of low signal, or one of the standard items, or a heading's beginning."""
    key = match_key(item)
    return low_signal_requirement(item) | (key == "") | key.isin(*BOILERPLATE) | key.rlike("^(?:" + "|".join(BOILERPLATE_STARTS) + ")")


def low_signal_date(item: Column) -> Column:
    x = F.trim(blank(item))
    return (F.char_length(x) < 4) | ~x.rlike(r"\d")


def low_signal_risk(item: Column) -> Column:
    x = F.trim(blank(item))
    return (F.char_length(x) < 6) | ((F.size(word_list(x)) <= 2) & (F.char_length(x) < 18))


def low_signal_requirement(item: Column) -> Column:
    """Short without being a known name, standard or code; or few words, mostly in capitals."""
    x = F.trim(blank(item))
    n, words = F.char_length(x), word_list(x)
    short = (n < 8) | ((F.size(words) <= 2) & (n < 18))
    known = F.lower(x).rlike(STANDARDS) | F.lower(x).isin(*SHORT_NAMES) | (F.contains(x, F.lit("/")) & (n <= 12)) | x.rlike(r"^[A-Z0-9/\\-]{2,10}$")
    capitals = F.size(F.filter(words, lambda w: (w == F.upper(w)) & (w != F.lower(w)))) / F.greatest(F.size(words), F.lit(1))
    return (x == "") | F.when(short, ~known).otherwise((F.size(words) <= 4) & (capitals >= 0.6))


def ordered_strings(items: Column) -> Column:
    """Items in order, each once."""
    return F.array_distinct(items)


def first_of_each(items: Column, key) -> Column:
    """Items in order, each key(item) once, none with an empty one. Sorted by key and place, an item stands if another key is before it."""
    placed = F.transform(items, lambda x, i: F.struct(key(x).alias("key"), i.alias("i"), x.alias("item")))
    by_key = lambda s: F.filter(s, lambda x, i: (x["key"] != "") & ((i == 0) | (F.get(s, i - 1)["key"] != x["key"])))
    by_place = F.array_sort(F.transform(let(F.array_sort(placed), by_key), lambda x: F.struct(x["i"].alias("i"), x["item"].alias("item"))))
    return F.transform(by_place, lambda x: x["item"])


def ordered_distinct(items: Column) -> Column:
    """Items in order, each match key once."""
    return first_of_each(items, match_key)


def clean_summary(df: DataFrame, evidence: str = "evidence") -> DataFrame:
    """requirements (8), dates (6), risks (6, no evidence needed) and attachments_used (4) of a summary, normalised: without what is
    boilerplate, of low signal or (requirements and dates) not in the evidence, each once."""
    says = lambda low: lambda x: ~is_boilerplate(x) & ~low(x)
    told = once(df, {f"__{n}": F.filter(n, says(low)) for n, low in (("requirements", low_signal_requirement), ("dates", low_signal_date), ("key_risks", low_signal_risk))})
    told = once(told, {f"__ok_{n}": with_support(F.col(f"__{n}"), F.col(evidence)) for n in ("requirements", "dates")})
    stands = lambda n: F.transform(F.filter(f"__ok_{n}", lambda x: x["ok"]), lambda x: x["item"])
    kept = {"requirements": (stands("requirements"), 8), "dates": (stands("dates"), 6), "key_risks": (F.col("__key_risks"), 6), "attachments_used": (F.col("attachments_used"), 4)}
    return told.withColumns({n: F.slice(ordered_distinct(x), 1, most) for n, (x, most) in kept.items()}).select(*df.columns)


# The categories of a structured summary, each with its test for low signal.
CATEGORIES = {"submission": low_signal_requirement, "evaluation": low_signal_requirement, "scope": low_signal_requirement, "deliverables": low_signal_requirement, "schedule": low_signal_date, "risks": low_signal_risk, "compliance": low_signal_requirement}
CITATION = "struct<attachment_id:string,section_heading:string,page:int,offsets:array<int>>"


def citations(given: Column, attachment: Column, heading: Column) -> Column:
    """Citations with the attachment and heading filled in where they lack one and two offsets or none; one that names the
    attachment where there is none."""
    other = lambda x, y: F.coalesce(F.nullif(blank(x), F.lit("")), blank(y))
    one = lambda c: F.struct(other(c["attachment_id"], attachment).alias("attachment_id"), other(c["section_heading"], heading).alias("section_heading"), c["page"].cast("int").alias("page"), F.when(F.size(c["offsets"]) >= 2, F.slice(c["offsets"], 1, 2)).alias("offsets"))
    told = F.transform(given, one).cast(f"array<{CITATION}>")
    none = F.array().cast(f"array<{CITATION}>")
    named = F.array(F.struct(attachment.alias("attachment_id"), blank(heading).alias("section_heading"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("array<int>").alias("offsets"))).cast(f"array<{CITATION}>")
    return F.when(F.coalesce(F.size(given), F.lit(0)) > 0, told).when(blank(attachment) != "", named).otherwise(none)


def clean_structured(df: DataFrame, attachment: str, evidence: str = "evidence") -> DataFrame:
    """Each category's array<struct<text, citations>> (with section_heading, if items have one): repaired texts, without those of low
    signal or (where there is evidence) without support in it, each match key once, with citations."""

    def told(name, low):
        kind = df.schema[name].dataType.elementType
        heading = lambda x: x["section_heading"] if "section_heading" in kind.names else F.lit("")
        items = F.transform(F.col(name), lambda x: F.struct(repair_leniently(F.trim(blank(x["text"]))).alias("text"), citations(x["citations"], F.col(attachment), heading(x)).alias("citations")))
        return F.filter(items, lambda x: (x["text"] != "") & ~low(x["text"]))

    names = {n: low for n, low in CATEGORIES.items() if n in df.columns}
    whole = once(df, {f"__{n}": told(n, low) for n, low in names.items()})
    whole = once(whole, {f"__ok_{n}": with_support(F.col(f"__{n}"), F.col(evidence), lambda x: x["text"]) for n in names})
    stands = lambda n: F.filter(f"__ok_{n}", lambda x: (blank(F.col(evidence)) == "") | x["ok"])
    out = whole.withColumns({n: first_of_each(F.transform(stands(n), lambda x: x["item"]), lambda x: match_key(x["text"])) for n in names})
    return out.select(*df.columns)


def route(item: Column) -> Column:
    """staffing if it holds a staffing word; submission if it holds a submission word and no technical one; else technical."""
    low = F.lower(blank(item))
    holds = lambda words: low.rlike("|".join(words))
    return F.when(holds(STAFFING_WORDS), "staffing").when(holds(SUBMISSION_WORDS) & ~holds(TECHNICAL_WORDS), "submission").otherwise("technical")


def routed(items: DataFrame, key: str, order: str, item: str, most: dict | None = None) -> DataFrame:
    """(key, class, rank, item): one submission and two technical items of each key, each once; staffing is dropped."""
    most = most or {"submission": 1, "technical": 2}
    told = items.withColumn("class", route(F.col(item))).filter(F.col("class").isin(*most) & (blank(F.col(item)) != ""))
    once = told.withColumn("__n", F.row_number().over(Window.partitionBy(key, item).orderBy(order))).filter("__n = 1")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(key, "class").orderBy(order)))
    limit = F.element_at(F.create_map(*[F.lit(x) for p in most.items() for x in p]), F.col("class"))
    return ranked.filter(F.col("rank") <= limit).select(key, "class", "rank", F.col(item).alias("item"))


def merged_items(items: DataFrame, key: str, order: str, item: str, most: int = 6) -> DataFrame:
    """(key, items): the first distinct items of each key, in order."""
    told = items.withColumn("__key", match_key(F.col(item))).filter("__key != ''")
    once = told.withColumn("__n", F.row_number().over(Window.partitionBy(key, "__key").orderBy(order))).filter("__n = 1")
    first = once.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("__n") <= most)
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.col(item).alias("item")))), lambda x: x["item"]).alias("items"))

"""What attachments say about notices: signals, notes, memos, bullets, structured items, coverage and job counts.

A summary is a struct: attachment_name, low_signal, memo, requirements, dates, key_risks (arrays of strings) and structured, an
array of struct<category, text, section_heading, page>. A notice has an array of summaries and an array of requirements
(struct<requirement, attachment_name>). Everything is a projection or one aggregation; nothing is gathered by notice.
"""

from __future__ import annotations

import html
import smtplib
import time
from collections.abc import Sequence
from email.message import EmailMessage

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import percentage
from ..functions.text import blank, cut_at_space, html_escape, let, match_key, scrub_pii, trimmed
from ..functions.urls import display_url
from .briefs import match_word
from .daily import windows
from .requirements import STAFFING_WORDS, SUBMISSION_WORDS, TECHNICAL_WORDS, ordered_strings

ITEM = "struct<category:string,text:string,section_heading:string,page:int>"
SUMMARY = f"struct<attachment_name:string,low_signal:boolean,memo:string,requirements:array<string>,dates:array<string>,key_risks:array<string>,structured:array<{ITEM}>>"
NEED = "struct<requirement:string,attachment_name:string>"

# Categories of structured items, in order.
CATEGORIES = ("submission", "evaluation", "scope", "deliverables", "schedule", "risks", "compliance")
# Words that tell the product family; buckets that do so by themselves; the line that says so.
PRODUCT_WORDS = ("sap", "s/4", "s4", "s/4hana", "hana", "ecc", "erp", "ariba", "successfactors")
PRODUCT_BUCKETS = ("erp modernization", "procurement", "hr/payroll", "integration/data", "ams")
PRODUCT_LINE = "Why it matters: SAP/ERP signal found."
# The sums that jobs report, for coverage and for enrichment.
METRICS = ("processed", "skipped", "unsupported", "too_large", "download_failed", "empty_text", "extraction_failed", "llm_gated", "llm_failed", "low_signal", "summary_exists", "requirements_extracted")
RATES = ("requirements", "dates", "evaluation", "submission", "summaries", "any_signal")


def some(x: Column) -> Column:
    return F.coalesce(F.size(x), F.lit(0)) > 0


def have(x: Column) -> Column:
    return F.nullif(blank(x), F.lit(""))


def joined(x: Column, most: int, by: str = ", ") -> Column:
    return F.array_join(F.slice(x, 1, most), by)


def names(summaries: Column, needs: Column) -> Column:
    """Distinct names of attachments: of the summaries, or, if none has one, of the requirements."""
    told = lambda xs: F.array_distinct(F.filter(F.transform(xs, lambda s: have(s["attachment_name"])), lambda n: n.isNotNull()))
    return F.when(F.size(told(summaries)) > 0, told(summaries)).otherwise(told(needs))


def attachment_signal(summaries: Column, needs: Column) -> Column:
    """How many attachments, requirements, whether dates and risks; empty if there is nothing to tell."""
    any_ = lambda f: F.exists(summaries, lambda s: some(s[f]))
    count = F.when(F.size(names(summaries, needs)) > 0, F.size(names(summaries, needs))).otherwise(F.size(summaries))
    yes = lambda c: F.when(c, "yes").otherwise("no")
    said = F.concat(F.lit("Attachment signal: "), count.cast("string"), F.lit(" attachments, reqs="), F.size(needs).cast("string"), F.lit(", dates="), yes(any_("dates")), F.lit(", risks="), yes(any_("key_risks")))
    return F.when((F.size(needs) > 0) | any_("dates") | any_("key_risks") | any_("structured"), said).otherwise(F.lit(""))


def note_lines(summaries: Column, most: int = 2, longest: int | None = None) -> Column:
    """`name: Reqs: a, b | Dates: c` of the first summaries that are not of low signal and have either."""

    def line(s: Column) -> Column:
        reqs, dates = (F.when(some(s[f]), F.concat(F.lit(label), joined(s[f], 2))) for f, label in (("requirements", "Reqs: "), ("dates", "Dates: ")))
        whole = F.concat(F.coalesce(have(s["attachment_name"]), F.lit("Attachment")), F.lit(": "), F.concat_ws(" | ", reqs, dates))
        return cut_at_space(whole, longest) if longest else whole

    told = F.filter(summaries, lambda s: ~F.coalesce(s["low_signal"], F.lit(False)) & (some(s["requirements"]) | some(s["dates"])))
    return F.slice(F.transform(told, line), 1, most)


def first_memo(summaries: Column) -> Column:
    return F.get(F.filter(F.transform(F.filter(summaries, lambda s: ~F.coalesce(s["low_signal"], F.lit(False))), lambda s: have(s["memo"])), lambda m: m.isNotNull()), F.lit(0))


def product_signal(text: Column, bucket: Column) -> Column:
    """Whether a product word stands in the text as a token, or the bucket says so. (Inside a longer word does not count.)"""
    key = F.concat(F.lit(" "), match_key(text), F.lit(" "))
    return key.rlike("(?: " + " | ".join(match_word(w) for w in PRODUCT_WORDS) + " )") | F.lower(blank(bucket)).isin(*PRODUCT_BUCKETS)


def attachment_note(summaries: Column, product: Column, most: int = 320) -> Column:
    """The note lines, or else the first memo, and what makes it matter; cut at a space."""
    lines = let(note_lines(summaries), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array_compact(F.array(first_memo(summaries)))))
    told = let(lines, lambda x: F.when((F.size(x) > 0) & product, F.concat(x, F.array(F.lit(PRODUCT_LINE)))).otherwise(x))
    return cut_at_space(F.trim(F.array_join(told, " ")), most)


def attachment_memo(name: Column, sections: Column, requirements: Column, dates: Column, risks: Column, most: int = 320) -> Column:
    """What an attachment says, in one line: name, two sections (or sheets), two of each kind; empty without a summary."""
    headings = F.slice(F.filter(F.transform(sections, lambda s: short(s)), lambda s: s != ""), 1, 2)
    sheets = F.lower(F.array_join(headings, " ")).rlike("sheet[ :]")
    label = F.when(sheets, "Sheets: ").otherwise("Sections: ")
    part = lambda title, x: F.when(some(x), F.concat(F.lit(f"{title}: "), joined(x, 2), F.lit(".")))
    return cut_at_space(
        F.concat_ws(" ", F.concat(F.lit("Attachment: "), have(name), F.lit(".")), F.when(some(headings), F.concat(label, F.array_join(headings, ", "), F.lit("."))), part("Requirements", requirements), part("Dates", dates), part("Risks", risks)),
        most,
    )


def short(x: Column, most: int = 80) -> Column:
    return cut_at_space(F.trim(F.regexp_replace(blank(x), r"\s+", " ")), most)


def fallback_memo(excerpt: Column, name: Column, most: int = 300) -> Column:
    """The beginning of a text, where there is no summary of it."""
    prefix = F.coalesce(F.concat(F.lit("Attachment: "), have(name), F.lit(". ")), F.lit(""))
    room = F.greatest(F.lit(0), F.lit(most - len("Doc excerpt: ")) - F.char_length(prefix))
    text = F.trim(F.regexp_replace(blank(excerpt), r"\s+", " "))
    head = F.substring(text, F.lit(1), room)
    cut = F.trim(F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, "^(.*) ", 1)).otherwise(head))
    said = F.when((room > 0) & (F.char_length(text) > room), cut).otherwise(text)
    return F.when(said != "", F.concat(prefix, F.lit("Doc excerpt: "), said)).otherwise(F.lit(""))


def brief_summary(buyer: Column, category: Column, fit: Column, needs: Column, close: Column, step: Column, confidence: Column, most: int = 300) -> Column:
    """A brief in a line: buyer, category and fit, two needs, closing date, next step, confidence."""
    named = have(F.trim(blank(buyer)))
    little = F.coalesce(F.concat(named, F.lit(": limited detail in notice; needs review.")), F.lit("Limited detail in notice; needs review."))
    fits = F.when(have(fit).isNotNull() & (fit != "unknown"), F.concat(F.lit(" (SAP fit: "), fit, F.lit(").")) ).otherwise(F.lit("."))
    head = F.concat(F.coalesce(F.concat(named, F.lit(": ")), F.lit("")), category, F.lit(" opportunity"), fits)
    vague = (F.coalesce(have(category), F.lit("other")) == "other") | ~some(needs)
    tail = [F.concat(F.lit(f"{label} "), have(x), F.lit(".")) for label, x in (("Closes", F.trim(blank(close))), ("Next:", step), ("Confidence:", confidence))]
    told = F.concat_ws(" ", F.when(vague, little).otherwise(head), F.when(~vague, F.concat(F.lit("Key needs: "), joined(needs, 2), F.lit("."))), *tail)
    return F.substring(told, 1, most)


def digest_bullets(summaries: Column, needs: Column, rationale: Column, product: Column, used: Column, brief: Column) -> Column:
    """Bullets in their order. brief: struct<summary, key_requirements, competitive_signals, recommended_next_step>."""
    one = lambda c: F.array_compact(F.array(c))
    label = lambda text, x: F.transform(x, lambda v: F.concat(F.lit(text), v))
    told = F.filter(F.transform(needs, lambda r: blank(r["requirement"])), lambda r: r != "")
    kind = lambda words: lambda t: F.lower(t).rlike("|".join(words))
    staffing, submission, technical = (kind(w) for w in (STAFFING_WORDS, SUBMISSION_WORDS, TECHNICAL_WORDS))
    free = F.filter(told, lambda t: ~staffing(t))
    submits = F.slice(ordered_strings(F.filter(free, lambda t: submission(t) & ~technical(t))), 1, 1)
    technics = F.slice(ordered_strings(F.filter(free, lambda t: ~submission(t) | technical(t))), 1, 2)
    texts = lambda x: F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda v: blank(v) != "")
    return F.flatten(
        F.array(
            one(have(rationale)), one(F.concat(F.lit("Brief: "), have(brief["summary"]))), one(have(attachment_signal(summaries, needs))), note_lines(summaries, 2, 200),
            one(F.when(product, F.lit(PRODUCT_LINE))), label("Req (submission): ", submits), label("Req (technical): ", technics), one(F.when(used & (F.size(needs) == 0), first_memo(summaries))),
            F.when(~used, label("Requirement: ", F.slice(texts(brief["key_requirements"]), 1, 3))).otherwise(F.array().cast("array<string>")), label("Competitive: ", F.slice(texts(brief["competitive_signals"]), 1, 2)),
            one(F.concat(F.lit("Next step: "), have(brief["recommended_next_step"]))),
        )
    )


def provenance(name: Column, section: Column, page: Column, known: Column) -> Column:
    """`name | section | p.N` of an item's first citation."""
    told = F.concat_ws(" | ", blank(name), F.coalesce(have(section), F.lit("n/a")), F.concat(F.lit("p."), F.coalesce(page.cast("string"), F.lit("?"))))
    return F.when(known, told).otherwise(F.concat(blank(name), F.lit(" | provenance unavailable")))


def structured_notes(notices: DataFrame, key: str, summaries: str, per_category: int = 2, most: int = 25) -> DataFrame:
    """(key, place, attachment_name, category, text, provenance): the first items of each category of each attachment, in order, as
    many as the digest has room for. Limits by category come first, so only few rows of a notice reach the limit of all."""
    s = notices.select(key, F.posexplode(summaries).alias("nth", "s"))
    order = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("item.category"))
    items = s.select(key, "nth", F.coalesce(have(F.col("s.attachment_name")), F.lit("Attachment")).alias("attachment_name"), F.posexplode("s.structured").alias("pos", "item")).withColumn("turn", order)
    items = items.filter((F.col("turn") > 0) & (trimmed(blank(F.col("item.text"))) != ""))
    items = items.withColumn("n", F.row_number().over(Window.partitionBy(key, "nth", "turn").orderBy("pos"))).filter(F.col("n") <= per_category)
    known = F.col("item.section_heading").isNotNull() | F.col("item.page").isNotNull()
    told = provenance(F.col("attachment_name"), F.col("item.section_heading"), F.col("item.page"), known)
    first = items.orderBy(key, "nth", "turn", "n").limit(most)
    return first.select(key, "nth", "turn", "n", "attachment_name", F.col("item.category").alias("category"), trimmed(F.col("item.text")).alias("text"), told.alias("provenance"))


def scrub_summary(summary: Column) -> Column:
    """A summary with e-mail addresses and phone numbers masked in its items; names and memo stay."""
    clean = lambda x: F.transform(x, scrub_pii)
    items = F.transform(summary["structured"], lambda i: i.withField("text", scrub_pii(blank(i["text"]))))
    out = summary
    for f in ("requirements", "dates", "key_risks"):
        out = out.withField(f, clean(summary[f]))
    return out.withField("structured", items)


def coverage_sums(attachments: str = "attachments", summaries: str = "summaries", needs: str = "needs", metrics: str = "metrics") -> dict[str, Column]:
    """How many notices have attachments, summaries, requirements, dates, evaluation, submission, any of these; the sums that jobs
    report. Each adds up over parts."""
    s = F.col(summaries)
    holds = lambda category: F.exists(s, lambda x: F.exists(x["structured"], lambda i: i["category"] == category))
    flags = {"with_attachments": some(F.col(attachments)), "with_summaries": some(s), "with_requirements": some(F.col(needs)), "with_dates": F.exists(s, lambda x: some(x["dates"])), "with_evaluation": holds("evaluation"), "with_submission": holds("submission")}
    flags["with_any_signal"] = flags["with_requirements"] | flags["with_dates"] | flags["with_evaluation"] | flags["with_submission"]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    jobs = {m: total(F.coalesce(F.col(f"{metrics}.{m}"), F.lit(0))) for m in METRICS}
    return {"notices": F.count("*")} | {n: count(c) for n, c in flags.items()} | {"attachments_total": total(F.greatest(F.coalesce(F.size(attachments), F.lit(0)), F.lit(0)))} | jobs


def coverage_rates(of=F.col) -> dict[str, Column]:
    """Rates in per cent of sums; of(name) is a sum."""
    return {f"{r}_rate": percentage(of(f"with_{r}"), of("notices")) for r in RATES} | {"low_signal_rate": percentage(of("low_signal"), of("summary_exists"))}


def coverage(notices: DataFrame, **columns: str) -> DataFrame:
    """One row of coverage_sums and their rates; added up on the map side."""
    return notices.agg(*[c.alias(n) for n, c in coverage_sums(**columns).items()]).withColumns(coverage_rates())


#: The windows of the coverage report, in days back from the day of the run (see daily.windows).
WINDOWS = {"baseline": (30, 0), "current_week": (7, 0), "previous_week": (14, 7), "current_run": (1, 0)}


def coverage_windows(parts: DataFrame, as_of: Column) -> DataFrame:
    """One row: a struct of sums for each of the report's windows, from daily parts of coverage_sums."""
    return windows(parts, as_of, WINDOWS, [c for c in parts.columns if c != "day"])


def acceptance(by_window: DataFrame, durations: DataFrame, took: Column, cited: Column) -> DataFrame:
    """The limits: coverage 75, summaries with signal 60, provenance present, no more than 1.2 times the mean of the last runs,
    at most 10 of low signal over the baseline. by_window is one row (coverage_windows), durations are a few."""
    mean = durations.agg(F.coalesce(F.floor(F.avg("seconds")), F.lit(0)).cast("long").alias("mean_seconds"))
    run, baseline = (lambda n, w=w: F.col(f"{w}.{n}") for w in ("current_run", "baseline"))
    signal = percentage(run("with_any_signal"), run("with_summaries"))
    within = (F.col("mean_seconds") == 0) | (took <= F.floor(F.col("mean_seconds") * 1.2))
    return by_window.crossJoin(mean).select(  # one row each
        (coverage_rates(run)["any_signal_rate"] >= 75).alias("coverage_ok"), (signal >= 60).alias("signal_ok"), cited.alias("provenance_ok"), within.alias("duration_ok"), (coverage_rates(baseline)["low_signal_rate"] <= 10).alias("low_signal_ok"),
        signal.alias("signal_rate"), F.col("mean_seconds"),
    )


def event_counters(notices: DataFrame, events: str = "events") -> DataFrame:
    """new: rows with the event new; updated: rows with other events only."""
    new = F.array_contains(events, "new")
    return notices.agg(F.count_if(some(F.col(events)) & new).alias("new"), F.count_if(some(F.col(events)) & ~new).alias("updated"))


def requirement_coverage(notices: DataFrame, needs: str = "needs") -> DataFrame:
    """with_requirements, total and the share in whole per cent (0 of none)."""
    out = notices.agg(F.count_if(some(F.col(needs))).alias("with_requirements"), F.count("*").alias("total"))
    return out.withColumn("percent", F.when(F.col("total") == 0, 0).otherwise(F.bround(F.col("with_requirements") / F.col("total") * 100)).cast("int"))


def enrichment_stats(jobs: DataFrame) -> DataFrame:
    """Counts over jobs: one row for each attachment, with status, found_by, needs_ocr, llm (requested, cached, skipped or null),
    size_bytes, text_chars, kind, members."""
    is_ = lambda c, v: F.count_if(F.coalesce(F.col(c) == v, F.lit(False)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    zipped = F.col("kind") == "zip"
    return jobs.agg(
        F.count("*").alias("attachments_total"), is_("status", "processed").alias("attachments_processed"), F.count_if(F.col("status") != "processed").alias("attachments_skipped"), F.count_if(F.col("found_by").isNull()).alias("downloaded"),
        F.count_if(F.col("found_by").isNotNull()).alias("cached"), is_("llm", "requested").alias("llm_requested"), is_("llm", "cached").alias("llm_cached"), is_("llm", "skipped").alias("llm_skipped"), F.count_if("needs_ocr").alias("ocr_used"),
        F.count_if(F.col("text_chars") == 0).alias("empty_text"), total("size_bytes").alias("bytes"), total("text_chars").alias("chars"), F.count_if(zipped).alias("zip_attachments"), total(F.when(zipped, F.col("members"))).alias("zip_files"), total(F.when(zipped, F.col("size_bytes"))).alias("zip_bytes"),
    )


# Columns of the exports, in order.
FLAGGED_COLUMNS = (
    "tender_key", "uid", "id", "solicitation_number", "amendment_number", "title", "org", "publish_date", "amendment_date", "updated_at", "close_date", "first_seen", "last_seen", "last_amendment_seen",
    "last_close_date_seen", "events", "score", "semantic_bucket", "semantic_similarity", "semantic_score", "rationale", "url",
)
NEAR_MISS_COLUMNS = ("tender_key", "uid", "id", "amendment_number", "title", "org", "updated_at", "close_date", "events", "url", "_reject_reason", "semantic_bucket", "semantic_similarity", "semantic_score", "rationale", "_hits")


def export(notices: DataFrame, columns: Sequence[str], labels: Column) -> DataFrame:
    """The columns as strings, in order; missing ones are empty; events as labels, structs and maps as JSON."""
    kinds = dict(notices.dtypes)

    def cell(c: str) -> Column:
        if c == "events":
            return labels
        if c not in kinds:
            return F.lit("")
        return F.to_json(c) if kinds[c].startswith(("struct", "map", "array")) else F.col(f"`{c}`").cast("string")

    return notices.select(*[blank(cell(c)).alias(c) for c in columns])


def near_miss_export(rejected: DataFrame, labels: Column, reasons: str = "reject_reasons") -> DataFrame:
    return export(rejected.filter(F.size(reasons) == 1), NEAR_MISS_COLUMNS, labels)


def reject_report(decided: DataFrame, generated_at: Column, reason: str = "reject_reason") -> DataFrame:
    """One row of JSON: {generated_at, totals: {candidates, kept, rejected}, reasons: {reason: count}}. A count for each reason is all
    that is gathered."""
    by = decided.groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"))
    told = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("kept"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))).alias("reasons"))
    totals = F.struct(F.col("all").alias("candidates"), "kept", (F.col("all") - F.col("kept")).alias("rejected"))
    return told.select(F.to_json(F.struct(generated_at.alias("generated_at"), totals.alias("totals"), "reasons")).alias("report"))


def cell(x: Column) -> Column:
    return F.concat(F.lit("<td>"), x, F.lit("</td>"))


def titled(notice: dict[str, Column], source: bool = True) -> Column:
    """A linked title with the organisation (and source) below; missing values have stand-ins."""
    told = lambda n, other: html_escape(F.coalesce(have(notice[n].cast("string")), F.lit(other)))
    below = F.concat(told("org", "Unknown org"), F.lit(" | "), told("source", "source")) if source else told("org", "Unknown org")
    return F.concat(F.lit('<a href="'), html_escape(display_url(blank(notice["url"]))), F.lit('">'), told("title", "Untitled"), F.lit("</a><br><small>"), below, F.lit("</small>"))


def flagged_row(notice: dict[str, Column], bullets: Column, labels: Column | None = None) -> Column:
    """A row of the sections for new and (with labels) updated notices."""
    items = F.array_join(F.transform(bullets, lambda b: F.concat(F.lit("<li>"), html_escape(b), F.lit("</li>"))), "")
    listed = F.when(items != "", F.concat(F.lit("<ul>"), items, F.lit("</ul>"))).otherwise(F.lit(""))
    cells = [cell(F.coalesce(notice["score"], F.lit(0)).cast("string")), cell(F.concat(titled(notice), listed)), cell(closing(notice))]
    return F.concat(F.lit("<tr>"), *cells, *([cell(html_escape(labels))] if labels is not None else []), F.lit("</tr>"))


def closing(notice: dict[str, Column]) -> Column:
    return html_escape(F.coalesce(have(notice["close_date"].cast("string")), F.lit("n/a")))


def watch_row(notice: dict[str, Column], labels: Column, reason: Column) -> Column:
    return F.concat(F.lit("<tr>"), cell(titled(notice)), cell(closing(notice)), cell(html_escape(labels)), cell(html_escape(blank(reason))), F.lit("</tr>"))


def upcoming_row(notice: dict[str, Column], days: Column) -> Column:
    return F.concat(F.lit("<tr>"), cell(titled(notice)), cell(closing(notice)), cell(blank(days.cast("string"))), F.lit("</tr>"))


def note_row(notice: dict[str, Column], memo: Column) -> Column:
    return F.concat(F.lit("<tr>"), cell(titled(notice, source=False)), cell(html_escape(memo)), F.lit("</tr>"))


def structured_row(notice: dict[str, Column], name: Column, category: Column, text: Column, cited: Column) -> Column:
    return F.concat(F.lit("<tr>"), cell(titled(notice, source=False)), *[cell(html_escape(blank(c))) for c in (name, category, text, cited)], F.lit("</tr>"))


# The digest's sections in order, with titles and column heads.
SECTIONS = {
    "notes": ("Attachment notes", ("Tender", "Note")), "structured": ("Attachment structured summary", ("Tender", "Attachment", "Category", "Item", "Source")), "new": ("High confidence (New)", ("Score", "Tender", "Closes")),
    "updated": ("High confidence (Updated/Amended)", ("Score", "Tender", "Closes", "Update")), "upcoming": ("Upcoming closes (next 7 days)", ("Tender", "Closes", "Days left")), "watch": ("Watchlist (near-miss)", ("Tender", "Closes", "Event", "Reason")),
}


def digest_html(rows: DataFrame, day: str, top: int, flagged: int, covered: dict | None = None, csv_path: str | None = None) -> str:
    """The digest as one page, on the driver. rows: (section, place, html) of the few notices a digest has (its sections are limited
    before); covered: with_requirements, total and percent."""
    by: dict[str, list[str]] = {}
    for r in rows.orderBy("section", "place").collect():
        by.setdefault(r["section"], []).append(r["html"])
    out = [f"<html><body><h2>Notices digest - {html.escape(day)}</h2>", f"<p>High-confidence items: <b>{top}</b> (of {flagged})</p>"]
    if covered and covered["total"]:
        out.append(f"<p>Attachment coverage: <b>{covered['percent']}%</b> ({covered['with_requirements']} of {covered['total']})</p>")
    if csv_path:
        out.append(f"<p>CSV exported to: <code>{html.escape(csv_path)}</code></p>")
    for name, (title, heads) in SECTIONS.items():
        if name in by:
            out += [f"<h3>{title}</h3>", "<table><thead><tr>", *[f"<th>{h}</th>" for h in heads], "</tr></thead><tbody>", *by[name], "</tbody></table>"]
    return "\n".join([*out, "</body></html>"])


def digest_message(sender: str, to: Sequence[str], subject: str, page: str, attachment: tuple[str, str] | None = None) -> EmailMessage:
    """The digest as a mail, with a CSV file (name and text) if there is one. Sending it is the caller's."""
    mail = EmailMessage()
    mail["From"], mail["To"], mail["Subject"] = sender, ", ".join(to), subject
    mail.set_content("This digest is written in HTML.")
    mail.add_alternative(page, subtype="html")
    if attachment:
        mail.add_attachment(attachment[1], subtype="csv", filename=attachment[0])
    return mail


def send(mail: EmailMessage, host: str, port: int = 587, login: tuple[str, str] | None = None, tls: bool = True, attempts: int = 3, wait: float = 2.0) -> None:
    """Sends a mail, again after failures of the connection, with a wait that grows by the same step; refusals are final."""
    for k in range(attempts):
        try:
            with smtplib.SMTP(host, port, timeout=60) as server:
                if tls:
                    server.starttls()
                if login:
                    server.login(*login)
                server.send_message(mail)
            return
        except (ConnectionError, TimeoutError, smtplib.SMTPServerDisconnected, smtplib.SMTPConnectError):
            if k == attempts - 1:
                raise
            time.sleep(wait * (k + 1))


def coverage_report(by_window: DataFrame) -> DataFrame:
    """(section, metric, value): each window's sums and rates, and weekly_delta from current_week and previous_week, all from the one
    row of coverage_windows."""
    said = lambda section, metric, value: F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))
    of = {w: (lambda n, w=w: F.col(f"{w}.{n}")) for w in WINDOWS}
    rates = {w: coverage_rates(at) for w, at in of.items()}
    listed = [said(w, n, of[w](n)) for w in WINDOWS for n in by_window.schema[w].dataType.names]
    listed += [said(w, r, c) for w in WINDOWS for r, c in rates[w].items()]
    listed += [said("weekly_delta", f"{r}_rate", F.round(rates["current_week"][f"{r}_rate"] - rates["previous_week"][f"{r}_rate"], 2)) for r in RATES]
    return by_window.select(F.inline(F.array(*listed)))

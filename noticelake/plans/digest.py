"""Queries over what attachments say, bound to customers as notices, each with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import daily, reports, state, summaries
from ..functions import numbers
from .registry import query, table

KINDS = ["submission", "evaluation", "scope", "risks", "other"]
NEEDS = ["Submit the bid by email", "Cloud integration", "Senior analyst level 3", "Keep records", "Submit data via the portal"]

# A customer as a notice: what its attachments say follows from its key k by rule.
SQL_NOTICES = f"""n0 AS (SELECT c_custkey AS k, c_name, c_mktsegment, c_acctbal, CASE WHEN c_custkey % 10 = 0 THEN 'SAP <rollout>' ELSE c_name END AS title, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END AS org,
  CASE c_custkey % 9 WHEN 0 THEN 'AMS' WHEN 1 THEN 'HR/payroll' ELSE 'unknown' END AS bucket, 'https://x.org/' || c_custkey || '?a=b' AS url FROM customer),
nt AS (SELECT *, list_transform(range(0, k % 3), lambda i: {{'attachment_name': CASE WHEN (k + i) % 6 = 0 THEN NULL ELSE 'file' || ((k + i) % 4) || '.pdf' END, 'low_signal': (k + i) % 5 = 0, 'memo': CASE WHEN (k + i) % 4 = 3 THEN '' ELSE 'Memo ' || i || ' of ' || k END,
    'requirements': list_transform(range(0, (k + i) % 4), lambda j: 'Need <' || j || '> & more of ' || k || ' from a' || j || '@x.org or 613-555-1234'), 'dates': CASE WHEN (k + i) % 2 = 0 THEN ['2026-01-0' || (i + 1)] ELSE []::VARCHAR[] END, 'key_risks': CASE WHEN k % 7 = 0 THEN ['late start'] ELSE []::VARCHAR[] END,
    'structured': list_transform(range(0, (k + i) % 5), lambda j: {{'category': {KINDS}[(k + j) % 5 + 1], 'text': CASE WHEN (k + j) % 6 = 0 THEN '  ' ELSE ' Item ' || j || ' of ' || k || ' ' END, 'section_heading': CASE WHEN (k + j) % 3 = 0 THEN NULL ELSE 'Part ' || j END, 'page': CASE WHEN (k + j) % 4 = 0 THEN NULL ELSE (j + 1)::INT END}})}}) AS ss,
  list_transform(range(0, k % 4), lambda j: {{'requirement': {NEEDS}[(k + j) % 5 + 1], 'attachment_name': CASE WHEN (k + j) % 2 = 0 THEN 'n' || j END}}) AS nn FROM n0)"""


def listed(most: int, size: Column, body) -> Column:
    return F.transform(F.slice(F.array(*[F.lit(i).cast("long") for i in range(most)]), F.lit(1), size.cast("int")), body)


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    pick = lambda words, at: F.element_at(F.array(*[F.lit(w) for w in words]), (at % len(words) + 1).cast("int"))

    def item(j):
        return F.struct(pick(KINDS, k + j).alias("category"), F.when((k + j) % 6 == 0, "  ").otherwise(text(" Item ", j, " of ", k, " ")).alias("text"), F.when((k + j) % 3 != 0, text("Part ", j)).alias("section_heading"), F.when((k + j) % 4 != 0, (j + 1).cast("int")).alias("page"))

    def summary(i):
        return F.struct(
            F.when((k + i) % 6 != 0, text("file", (k + i) % 4, ".pdf")).alias("attachment_name"), ((k + i) % 5 == 0).alias("low_signal"), F.when((k + i) % 4 == 3, "").otherwise(text("Memo ", i, " of ", k)).alias("memo"),
            listed(4, (k + i) % 4, lambda j: text("Need <", j, "> & more of ", k, " from a", j, "@x.org or 613-555-1234")).alias("requirements"), F.when((k + i) % 2 == 0, F.array(text("2026-01-0", i + 1))).otherwise(none).alias("dates"),
            F.when(k % 7 == 0, F.array(F.lit("late start"))).otherwise(none).alias("key_risks"), listed(5, (k + i) % 5, item).alias("structured"),
        )

    return table(spark, sf_dir, "customer").select(
        k.alias("k"), F.when(k % 10 == 0, "SAP <rollout>").otherwise(F.col("c_name")).alias("title"), F.when(k % 11 == 0, "").otherwise(F.col("c_mktsegment")).alias("org"), F.when(k % 9 == 0, "AMS").when(k % 9 == 1, "HR/payroll").otherwise("unknown").alias("bucket"),
        text("https://x.org/", k, "?a=b").alias("url"), "c_acctbal", listed(3, k % 3, summary).alias("summaries"), listed(4, k % 4, lambda j: F.struct(pick(NEEDS, k + j).alias("requirement"), F.when((k + j) % 2 == 0, text("n", j)).alias("attachment_name"))).alias("needs"),
    )


def cut_sql(x: str, most: int) -> str:
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE coalesce(nullif(trim(regexp_extract(substr({x}, 1, {most}), '^(.*) ', 1, 's')), ''), trim(substr({x}, 1, {most}))) END"


def have_sql(xs: str) -> str:
    return f"list_distinct(list_filter(list_transform({xs}, lambda s: nullif(s.attachment_name, '')), lambda x: x IS NOT NULL))"


SIGNAL = f"""CASE WHEN len(nn) > 0 OR len(list_filter(ss, lambda s: len(s.dates) > 0 OR len(s.key_risks) > 0 OR len(s.structured) > 0)) > 0 THEN 'Attachment signal: ' || (CASE WHEN len(names) > 0 THEN len(names) ELSE len(ss) END) || ' attachments, reqs=' || len(nn) ||
  ', dates=' || CASE WHEN len(list_filter(ss, lambda s: len(s.dates) > 0)) > 0 THEN 'yes' ELSE 'no' END || ', risks=' || CASE WHEN len(list_filter(ss, lambda s: len(s.key_risks) > 0)) > 0 THEN 'yes' ELSE 'no' END ELSE '' END"""
NAMED = f"{SQL_NOTICES}, nm AS (SELECT *, CASE WHEN len({have_sql('ss')}) > 0 THEN {have_sql('ss')} ELSE {have_sql('nn')} END AS names FROM nt)"


@query(f"WITH {NAMED} SELECT k, len(names)::INT AS n_names, {SIGNAL} AS signal FROM nm")
def attachment_signals(spark, sf_dir):
    s, n = F.col("summaries"), F.col("needs")
    return notices(spark, sf_dir).select("k", F.size(summaries.names(s, n)).alias("n_names"), summaries.attachment_signal(s, n).alias("signal"))


def words_sql(xs: str, label: str) -> str:
    return f"CASE WHEN len({xs}) > 0 THEN '{label}' || array_to_string({xs}[1:2], ', ') END"


LINE = f"coalesce(nullif(s.attachment_name, ''), 'Attachment') || ': ' || concat_ws(' | ', {words_sql('s.requirements', 'Reqs: ')}, {words_sql('s.dates', 'Dates: ')})"
TOLD = "list_filter(ss, lambda s: NOT s.low_signal AND (len(s.requirements) > 0 OR len(s.dates) > 0))"
MEMO = "list_filter(list_transform(list_filter(ss, lambda s: NOT s.low_signal), lambda s: nullif(s.memo, '')), lambda m: m IS NOT NULL)[1]"
PRODUCT = "(regexp_matches(' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ', '(?: " + " | ".join(summaries.match_word(w) for w in summaries.PRODUCT_WORDS) + f" )') OR lower(bucket) IN ({', '.join(repr(b) for b in summaries.PRODUCT_BUCKETS)}))"


def product() -> Column:
    return summaries.product_signal(F.col("title"), F.col("bucket"))


@query(f"""WITH {SQL_NOTICES}, a AS (SELECT k, {PRODUCT} AS product, (list_transform({TOLD}, lambda s: {LINE}))[1:2] AS lines, {MEMO} AS memo FROM nt), b AS (SELECT k, product, CASE WHEN len(lines) > 0 THEN lines WHEN memo IS NOT NULL THEN [memo] ELSE []::VARCHAR[] END AS lines FROM a),
c AS (SELECT k, product, trim(array_to_string(CASE WHEN len(lines) > 0 AND product THEN list_append(lines, '{summaries.PRODUCT_LINE}') ELSE lines END, ' ')) AS note FROM b) SELECT k, product, {cut_sql('note', 320)} AS note FROM c""")
def attachment_notes(spark, sf_dir):
    return notices(spark, sf_dir).select("k", product().alias("product"), summaries.attachment_note(F.col("summaries"), product()).alias("note"))


@query(f"""WITH {SQL_NOTICES}, a AS (SELECT k, i, s, list_transform(s.structured, lambda x: x.section_heading) AS heads FROM (SELECT k, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i FROM nt)),
b AS (SELECT *, (list_filter(heads, lambda h: coalesce(h, '') <> ''))[1:2] AS two FROM a), c AS (SELECT k, i, s, concat_ws(' ', 'Attachment: ' || nullif(s.attachment_name, '') || '.', CASE WHEN len(two) > 0 THEN 'Sections: ' || array_to_string(two, ', ') || '.' END,
  CASE WHEN len(s.requirements) > 0 THEN 'Requirements: ' || array_to_string(s.requirements[1:2], ', ') || '.' END, CASE WHEN len(s.dates) > 0 THEN 'Dates: ' || array_to_string(s.dates[1:2], ', ') || '.' END, CASE WHEN len(s.key_risks) > 0 THEN 'Risks: ' || array_to_string(s.key_risks[1:2], ', ') || '.' END) AS memo FROM b)
SELECT k, i::INT AS i, {cut_sql('memo', 320)} AS memo FROM c""")
def attachment_memos(spark, sf_dir):
    each = notices(spark, sf_dir).select("k", F.posexplode("summaries").alias("i", "s"))
    headings = F.transform(F.col("s.structured"), lambda x: x["section_heading"])
    return each.select("k", "i", summaries.attachment_memo(F.col("s.attachment_name"), headings, F.col("s.requirements"), F.col("s.dates"), F.col("s.key_risks")).alias("memo"))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'f' || doc_id || '.pdf' END AS name FROM documents), p AS (SELECT *, CASE WHEN name = '' THEN '' ELSE 'Attachment: ' || name || '. ' END AS prefix FROM t),
r AS (SELECT *, 287 - length(prefix) AS room FROM p), c AS (SELECT doc_id, prefix, CASE WHEN length(t) > room THEN trim(CASE WHEN contains(substr(t, 1, room), ' ') THEN regexp_extract(substr(t, 1, room), '^(.*) ', 1) ELSE substr(t, 1, room) END) ELSE t END AS said FROM r)
SELECT doc_id, CASE WHEN said <> '' THEN prefix || 'Doc excerpt: ' || said ELSE '' END AS memo FROM c""")
def fallback_memos(spark, sf_dir):
    name = F.when(F.col("doc_id") % 2 == 0, "").otherwise(text("f", F.col("doc_id"), ".pdf"))
    return table(spark, sf_dir, "documents").select("doc_id", summaries.fallback_memo(F.col("text"), name).alias("memo"))


CATEGORY = ["other", "procurement", "ERP modernization", ""]
FIT = ["unknown", "strong", "weak", ""]


@query(f"""WITH {SQL_NOTICES}, a AS (SELECT k, nullif(trim(org), '') AS buyer, {CATEGORY}[k % 4 + 1] AS category, {FIT}[k // 4 % 4 + 1] AS fit, list_transform(nn, lambda r: r.requirement) AS needs, CASE WHEN k % 5 = 0 THEN '' ELSE '2026-02-0' || (k % 9 + 1) END AS close, CASE WHEN k % 6 = 0 THEN 'Review scope' ELSE '' END AS step, CASE WHEN k % 3 = 0 THEN 'low' ELSE 'high' END AS conf FROM nt),
b AS (SELECT *, coalesce(nullif(category, ''), 'other') = 'other' OR len(needs) = 0 AS vague FROM a)
SELECT k, substr(concat_ws(' ', CASE WHEN vague THEN coalesce(buyer || ': limited detail in notice; needs review.', 'Limited detail in notice; needs review.') ELSE coalesce(buyer || ': ', '') || category || ' opportunity' || CASE WHEN fit NOT IN ('', 'unknown') THEN ' (SAP fit: ' || fit || ').' ELSE '.' END END,
  CASE WHEN NOT vague THEN 'Key needs: ' || array_to_string(needs[1:2], ', ') || '.' END, 'Closes ' || nullif(close, '') || '.', 'Next: ' || nullif(step, '') || '.', 'Confidence: ' || conf || '.'), 1, 300) AS summary FROM b""")
def brief_summaries(spark, sf_dir):
    k = F.col("k")
    pick = lambda words, at: F.element_at(F.array(*[F.lit(w) for w in words]), (at % len(words) + 1).cast("int"))
    said = summaries.brief_summary(
        F.col("org"), pick(CATEGORY, k), pick(FIT, F.floor(k / 4)), F.transform("needs", lambda r: r["requirement"]), F.when(k % 5 == 0, "").otherwise(text("2026-02-0", k % 9 + 1)), F.when(k % 6 == 0, "Review scope").otherwise(""), F.when(k % 3 == 0, "low").otherwise("high"),
    )
    return notices(spark, sf_dir).select("k", said.alias("summary"))


def holds_sql(words, x="t") -> str:
    return f"regexp_matches(lower({x}), '{'|'.join(words)}')"


STAFF, SUBMIT, TECH = (holds_sql(w) for w in (summaries.STAFFING_WORDS, summaries.SUBMISSION_WORDS, summaries.TECHNICAL_WORDS))
FIRST = "list_filter({x}, lambda v, i: list_position({x}, v) = i)"


@query(f"""WITH {NAMED}, a AS (SELECT k, ss, nn, {SIGNAL} AS signal, {PRODUCT} AS product, k % 2 = 0 AS used, list_filter(list_transform(nn, lambda r: r.requirement), lambda t: NOT {STAFF}) AS free, (list_transform({TOLD}, lambda s: {LINE}))[1:2] AS lines, {MEMO} AS memo FROM nm),
b AS (SELECT *, list_filter(free, lambda t: {SUBMIT} AND NOT {TECH}) AS sub, list_filter(free, lambda t: NOT {SUBMIT} OR {TECH}) AS tec FROM a)
SELECT k, array_to_string(flatten([CASE WHEN k % 4 = 0 THEN ['Rules: x'] ELSE [] END, CASE WHEN k % 3 = 0 THEN [] ELSE ['Brief: b' || k] END, CASE WHEN signal = '' THEN [] ELSE [signal] END, list_transform(lines, lambda l: {cut_sql('l', 200)}), CASE WHEN product THEN ['{summaries.PRODUCT_LINE}'] ELSE [] END,
  list_transform(({FIRST.format(x='sub')})[1:1], lambda t: 'Req (submission): ' || t), list_transform(({FIRST.format(x='tec')})[1:2], lambda t: 'Req (technical): ' || t), CASE WHEN used AND len(nn) = 0 AND memo IS NOT NULL THEN [memo] ELSE [] END,
  CASE WHEN NOT used THEN list_transform((['one', 'two', 'three', 'four'])[1:3], lambda v: 'Requirement: ' || v) ELSE [] END, CASE WHEN k % 5 = 0 THEN ['Competitive: incumbent'] ELSE [] END, CASE WHEN k % 6 = 0 THEN ['Next step: go'] ELSE [] END]::VARCHAR[][]), '|') AS bullets FROM b""")
def digest_bullets(spark, sf_dir):
    k = F.col("k")
    none = F.array().cast("array<string>")
    brief = F.struct(F.when(k % 3 == 0, "").otherwise(text("b", k)).alias("summary"), F.array(*[F.lit(w) for w in ("one", "", "two", "three", "four")]).alias("key_requirements"), F.when(k % 5 == 0, F.array(F.lit("incumbent"))).otherwise(none).alias("competitive_signals"), F.when(k % 6 == 0, "go").alias("recommended_next_step"))
    told = summaries.digest_bullets(F.col("summaries"), F.col("needs"), F.when(k % 4 == 0, "Rules: x"), product(), k % 2 == 0, brief)
    return notices(spark, sf_dir).select("k", F.array_join(told, "|").alias("bullets"))


@query(f"""WITH {SQL_NOTICES}, a AS (SELECT k, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS nth FROM nt), b AS (SELECT k, nth, coalesce(nullif(s.attachment_name, ''), 'Attachment') AS attachment_name, unnest(s.structured) AS item, generate_subscripts(s.structured, 1) AS pos FROM a),
c AS (SELECT *, list_position({list(summaries.CATEGORIES)}, item.category) AS turn FROM b WHERE trim(item.text) <> ''), d AS (SELECT *, row_number() OVER (PARTITION BY k, nth, turn ORDER BY pos) AS n FROM c WHERE turn > 0)
SELECT k, nth::INT AS nth, turn::INT AS turn, n::INT AS n, attachment_name, item.category AS category, trim(item.text) AS text, CASE WHEN item.section_heading IS NULL AND item.page IS NULL THEN attachment_name || ' | provenance unavailable' ELSE attachment_name || ' | ' || coalesce(item.section_heading, 'n/a') || ' | p.' || coalesce(item.page::VARCHAR, '?') END AS provenance
FROM d WHERE n <= 2 ORDER BY k, nth, turn, n LIMIT 25""")
def structured_notes(spark, sf_dir):
    out = summaries.structured_notes(notices(spark, sf_dir), "k", "summaries")
    return out.withColumn("turn", F.col("turn").cast("int"))


MASK = "regexp_replace(regexp_replace({x}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '[REDACTED_EMAIL]', 'g'), '\\b(?:\\+?\\d{{1,3}}[-.\\s]?)?(?:\\(?\\d{{3}}\\)?[-.\\s]?)\\d{{3}}[-.\\s]?\\d{{4}}\\b', '[REDACTED_PHONE]', 'g')"


@query(f"""WITH {SQL_NOTICES}, a AS (SELECT k, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i FROM nt)
SELECT k, i::INT AS i, s.attachment_name AS name, array_to_string(list_transform(s.requirements, lambda x: {MASK.format(x='x')}), '|') AS requirements, array_to_string(list_transform(s.structured, lambda x: x.text), '|') AS items,
len(list_filter(s.requirements, lambda x: contains({MASK.format(x='x')}, 'REDACTED')))::INT AS masked FROM a""")
def scrubbed_summaries(spark, sf_dir):
    each = notices(spark, sf_dir).select("k", F.posexplode("summaries").alias("i", "s")).withColumn("s", summaries.scrub_summary(F.col("s")))
    masked = F.size(F.filter("s.requirements", lambda x: F.contains(x, F.lit("REDACTED"))))
    return each.select("k", "i", F.col("s.attachment_name").alias("name"), F.array_join("s.requirements", "|").alias("requirements"), F.array_join(F.transform("s.structured", lambda x: x["text"]), "|").alias("items"), masked.alias("masked"))


# ---- coverage: customers as notices, seen at a day of January by key ----

METRIC_SQL = ", ".join(f"'{m}': (k + {j}) % {j + 2}" for j, m in enumerate(summaries.METRICS))
COVERED = f"{SQL_NOTICES}, cv AS (SELECT *, list_transform(range(0, k % 2), lambda x: 'a') AS attachments, {{{METRIC_SQL}}} AS m, (k % 40)::INT AS age FROM nt)"
FLAG_SQL = {
    "with_attachments": "len(attachments) > 0", "with_summaries": "len(ss) > 0", "with_requirements": "len(nn) > 0", "with_dates": "len(list_filter(ss, lambda s: len(s.dates) > 0)) > 0",
    "with_evaluation": "len(list_filter(ss, lambda s: len(list_filter(s.structured, lambda i: i.category = 'evaluation')) > 0)) > 0", "with_submission": "len(list_filter(ss, lambda s: len(list_filter(s.structured, lambda i: i.category = 'submission')) > 0)) > 0",
}
FLAG_SQL["with_any_signal"] = " OR ".join(f"({FLAG_SQL[f]})" for f in ("with_requirements", "with_dates", "with_evaluation", "with_submission"))


def stats_sql(where: str = "true") -> str:
    counts = ", ".join(f"count_if({c}) AS {n}" for n, c in FLAG_SQL.items())
    sums = ", ".join(f"coalesce(sum(m.{m}), 0)::BIGINT AS {m}" for m in summaries.METRICS)
    rates = ", ".join(f"CASE WHEN notices = 0 THEN 0 ELSE round(with_{r} / notices * 100, 2) END AS {r}_rate" for r in summaries.RATES)
    return f"SELECT *, {rates}, CASE WHEN summary_exists = 0 THEN 0 ELSE round(low_signal / summary_exists * 100, 2) END AS low_signal_rate FROM (SELECT count(*) AS notices, {counts}, coalesce(sum(len(attachments)), 0)::BIGINT AS attachments_total, {sums} FROM cv WHERE {where})"


def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    metrics = F.struct(*[((k + j) % (j + 2)).alias(m) for j, m in enumerate(summaries.METRICS)])
    return notices(spark, sf_dir).withColumns({"attachments": listed(2, k % 2, lambda _: F.lit("a")), "metrics": metrics, "age": (k % 40).cast("int")})


def coverage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's windows from daily parts: a notice's age in days tells its day."""
    today = F.lit("2026-01-30").cast("date")
    parts = daily.daily_parts(covered(spark, sf_dir), F.date_sub(today, F.col("age")), summaries.coverage_sums())
    return summaries.coverage_windows(parts, today)


@query(f"WITH {COVERED} {stats_sql()}")
def attachment_coverage(spark, sf_dir):
    return summaries.coverage(covered(spark, sf_dir))


WINDOWS = {"baseline": "age < 30", "current_week": "age < 7", "previous_week": "age >= 7 AND age < 14", "current_run": "age = 0"}
ALL_STATS = ["notices", *FLAG_SQL, "attachments_total", *summaries.METRICS, *(f"{r}_rate" for r in summaries.RATES), "low_signal_rate"]


def tall_sql(x: str, names, section: str) -> str:
    return f"SELECT '{section}' AS section, x.metric AS metric, x.value AS value FROM (SELECT unnest([{', '.join(f'''{{'metric': '{n}', 'value': {e}::DOUBLE}}''' for n, e in names)}]) AS x FROM {x})"


REPORT = f"WITH {COVERED}, " + ", ".join(f"w_{w} AS ({stats_sql(c)})" for w, c in WINDOWS.items())


@query(REPORT + " " + " UNION ALL ".join([tall_sql(f"w_{w}", [(n, n) for n in ALL_STATS], w) for w in WINDOWS] + [tall_sql("w_current_week a, w_previous_week b", [(f"{r}_rate", f"round(a.{r}_rate - b.{r}_rate, 2)") for r in summaries.RATES], "weekly_delta")]))
def coverage_report(spark, sf_dir):
    """All windows of the report, and the change of the week."""
    return summaries.coverage_report(coverage_windows(spark, sf_dir))


@query(f"""{REPORT}, du AS (SELECT (user_id * 60)::BIGINT AS seconds FROM events WHERE event_type = 'purchase' ORDER BY ts DESC LIMIT 5), me AS (SELECT coalesce(floor(avg(seconds)), 0)::BIGINT AS mean_seconds FROM du),
sg AS (SELECT r.*, b.low_signal_rate AS baseline_rate, mean_seconds, CASE WHEN r.with_summaries = 0 THEN 0 ELSE round(r.with_any_signal / r.with_summaries * 100, 2) END AS signal_rate FROM w_current_run r, w_baseline b, me)
SELECT any_signal_rate >= 75 AS coverage_ok, signal_rate >= 60 AS signal_ok, true AS provenance_ok, mean_seconds = 0 OR 4000 <= floor(mean_seconds * 1.2) AS duration_ok, baseline_rate <= 10 AS low_signal_ok, signal_rate, mean_seconds FROM sg""")
def acceptance(spark, sf_dir):
    """The run's limits; purchases stand for earlier runs (see recent_durations), this one took 4000 seconds."""
    started = F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.col("user_id").cast("int"))
    runs = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.lit("ok").alias("status"), started.alias("started_at"), F.col("ts").alias("finished_at"))
    return summaries.acceptance(coverage_windows(spark, sf_dir), state.recent_durations(runs), F.lit(4000), F.lit(True))


@query("SELECT count_if(c_custkey % 5 <> 0 AND c_custkey % 3 = 0) AS new, count_if(c_custkey % 5 <> 0 AND c_custkey % 3 <> 0) AS updated FROM customer")
def event_counters(spark, sf_dir):
    k = F.col("c_custkey")
    events = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 3 == 0, F.array(F.lit("new"))).otherwise(F.array(F.lit("amendment")))
    return summaries.event_counters(table(spark, sf_dir, "customer").select(events.alias("events")))


@query("SELECT count_if(c_custkey % 4 > 0) AS with_requirements, count(*) AS total, CAST(round_even(count_if(c_custkey % 4 > 0) / count(*) * 100, 0) AS INT) AS percent FROM customer")
def requirement_coverage(spark, sf_dir):
    return summaries.requirement_coverage(notices(spark, sf_dir))


@query("""WITH j AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'unsupported' ELSE 'processed' END AS status, CASE WHEN event_id % 4 = 0 THEN 'meta' WHEN event_id % 4 = 1 THEN 'content' END AS found_by, event_id % 5 = 0 AS ocr, ['requested', 'cached', 'skipped', NULL][event_id % 4 + 1] AS llm,
  user_id * 10 AS size_bytes, CASE WHEN event_id % 6 = 0 THEN 0 ELSE user_id END AS text_chars, event_id % 7 = 0 AS zipped FROM events)
SELECT count(*) AS attachments_total, count_if(status = 'processed') AS attachments_processed, count_if(status <> 'processed') AS attachments_skipped, count_if(found_by IS NULL) AS downloaded, count_if(found_by IS NOT NULL) AS cached, count_if(llm = 'requested') AS llm_requested, count_if(llm = 'cached') AS llm_cached,
count_if(llm = 'skipped') AS llm_skipped, count_if(ocr) AS ocr_used, count_if(text_chars = 0) AS empty_text, sum(size_bytes)::BIGINT AS bytes, sum(text_chars)::BIGINT AS chars, count_if(zipped) AS zip_attachments, coalesce(sum(3) FILTER (zipped), 0)::BIGINT AS zip_files, coalesce(sum(size_bytes) FILTER (zipped), 0)::BIGINT AS zip_bytes FROM j""")
def enrichment_stats(spark, sf_dir):
    e = F.col("event_id")
    jobs = table(spark, sf_dir, "events").select(
        F.when(e % 3 == 0, "unsupported").otherwise("processed").alias("status"), F.when(e % 4 == 0, "meta").when(e % 4 == 1, "content").alias("found_by"), (e % 5 == 0).alias("needs_ocr"), F.when(e % 4 == 0, "requested").when(e % 4 == 1, "cached").when(e % 4 == 2, "skipped").alias("llm"),
        (F.col("user_id") * 10).alias("size_bytes"), F.when(e % 6 == 0, 0).otherwise(F.col("user_id")).alias("text_chars"), F.when(e % 7 == 0, "zip").otherwise("pdf").alias("kind"), F.lit(3).alias("members"),
    )
    return summaries.enrichment_stats(jobs)


# ---- exports ----


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return notices(spark, sf_dir).select(
        text("cb:", k).alias("tender_key"), text("cb:", k, ":am1").alias("uid"), "title", "org", "url", F.col("bucket").alias("semantic_bucket"), k.cast("int").alias("score"), F.struct(F.array(F.lit("erp")).alias("domain")).alias("_hits"),
        F.when(k % 3 == 0, F.array(F.lit("new"))).otherwise(F.array(F.lit("amendment"), F.lit("odd"))).alias("events"), F.when(k % 4 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("reject_reasons"), F.when(k % 4 == 0, "a").alias("_reject_reason"),
    )


EXPORT_SQL = {"tender_key": "'cb:' || k", "uid": "'cb:' || k || ':am1'", "title": "title", "org": "org", "url": "url", "semantic_bucket": "bucket", "events": "CASE WHEN k % 3 = 0 THEN 'New tender' ELSE 'Amendment posted; odd' END"}


def export_sql(columns, more: dict) -> str:
    cells = EXPORT_SQL | more
    return f"WITH {SQL_NOTICES} SELECT " + ", ".join(f"coalesce({cells.get(c, repr(''))}, '') AS {c}" for c in columns) + " FROM nt"


@query(export_sql(summaries.FLAGGED_COLUMNS, {"score": "k::VARCHAR"}))
def flagged_export(spark, sf_dir):
    return summaries.export(exported(spark, sf_dir), summaries.FLAGGED_COLUMNS, reports.event_labels(F.col("events")))


@query(export_sql(summaries.NEAR_MISS_COLUMNS, {"_reject_reason": "'a'", "_hits": """'{"domain":["erp"]}'"""}) + " WHERE k % 4 = 0")
def near_miss_export(spark, sf_dir):
    return summaries.near_miss_export(exported(spark, sf_dir), reports.event_labels(F.col("events")))


@query("""WITH c AS (SELECT o_orderpriority AS reason, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT string_agg('"' || reason || '":' || n, ',' ORDER BY reason) AS reasons, sum(n)::BIGINT AS rejected FROM c WHERE reason <> '5-LOW'), k AS (SELECT coalesce(sum(n), 0)::BIGINT AS kept FROM c WHERE reason = '5-LOW')
SELECT '{"generated_at":"2026-01-30T00:00:00Z","totals":{"candidates":' || (kept + rejected) || ',"kept":' || kept || ',"rejected":' || rejected || '},"reasons":{' || reasons || '}}' AS report FROM r, k""")
def reject_report_json(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("reject_reason"))
    return summaries.reject_report(o, F.lit("2026-01-30T00:00:00Z"))


ESC = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
LINK = "'<a href=\"https://x.org/' || k || '\">' || " + ESC.format(x="title") + " || '</a><br><small>' || " + ESC.format(x="coalesce(nullif(org, ''), 'Unknown org')")


@query(f"""WITH {SQL_NOTICES}, a AS (SELECT *, k % 6 AS part FROM nt) SELECT k, CASE part WHEN 0 THEN 'new' WHEN 1 THEN 'updated' WHEN 2 THEN 'watch' WHEN 3 THEN 'upcoming' WHEN 4 THEN 'notes' ELSE 'structured' END AS section,
'<tr>' || CASE part WHEN 0 THEN '<td>' || k || '</td><td>' || {LINK} || ' | source</small><ul><li>a &lt; b</li></ul></td><td>n/a</td>' WHEN 1 THEN '<td>' || k || '</td><td>' || {LINK} || ' | source</small></td><td>n/a</td><td>New tender</td>'
  WHEN 2 THEN '<td>' || {LINK} || ' | source</small></td><td>n/a</td><td>New tender</td><td>why</td>' WHEN 3 THEN '<td>' || {LINK} || ' | source</small></td><td>n/a</td><td>3</td>' WHEN 4 THEN '<td>' || {LINK} || '</small></td><td>m &amp; n</td>' ELSE '<td>' || {LINK} || '</small></td><td>f</td><td>scope</td><td>t</td><td>p</td>' END || '</tr>' AS html FROM a""")
def digest_sections(spark, sf_dir):
    """Rows of all six sections of the digest."""
    k = F.col("k")
    d = notices(spark, sf_dir).withColumns({"source": F.lit(""), "score": k, "close_date": F.lit(None).cast("string")})
    n = {c: F.col(c) for c in ("title", "org", "url", "source", "score", "close_date")}
    some, none, new = F.array(F.lit("a < b")), F.array().cast("array<string>"), F.lit("New tender")
    rows = [
        ("new", summaries.flagged_row(n, some)), ("updated", summaries.flagged_row(n, none, new)), ("watch", summaries.watch_row(n, new, F.lit("why"))), ("upcoming", summaries.upcoming_row(n, F.lit(3))), ("notes", summaries.note_row(n, F.lit("m & n"))),
        ("structured", summaries.structured_row(n, F.lit("f"), F.lit("scope"), F.lit("t"), F.lit("p"))),
    ]
    name, row = F.lit(None).cast("string"), F.lit(None).cast("string")
    for at, (section, made) in enumerate(rows):
        name, row = F.when(k % 6 == at, section).otherwise(name), F.when(k % 6 == at, made).otherwise(row)
    return d.select("k", name.alias("section"), row.alias("html"))


@query(f"""WITH {SQL_NOTICES}, s AS (SELECT k, k % 100 / 100 AS sim, CASE WHEN k % 2 = 0 THEN 8 ELSE 0 END + least(18, 6 * (k % 5)) + least(15, 5 * (k % 4)) + CASE WHEN k % 3 = 0 THEN 6 ELSE 0 END AS evidence FROM nt)
SELECT k, evidence::INT AS evidence, least(120, round_even(100 * sim, 0)::INT + evidence)::INT AS score FROM s""")
def semantic_score(spark, sf_dir):
    k = F.col("k")
    d = notices(spark, sf_dir).select("k", numbers.evidence_score((k % 2 == 0).cast("int"), (k % 5).cast("int"), (k % 4).cast("int"), (k % 3 == 0).cast("int")).alias("evidence"))
    return d.select("k", F.col("evidence").cast("int").alias("evidence"), numbers.semantic_score(k % 100 / 100, F.col("evidence")).alias("score"))

"""The registered queries of the library's own operators, each with the SQL that gives the same rows in DuckDB.

The test tables hold no notices, so each operator is bound to the nearest table: documents stand for notices and long
documents, orders for versioned records, events for runs and streams, embeddings for text vectors, pages for attachments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text, urls
from ..operators import documents, evidence, lookups, reports, requirements, rules, state, vectors
from ..plans import terms
from ..sources import files
from ..streaming import keyed
from ..streaming import state as streaming
from ..streaming.buckets import BucketedTable
from .registry import QUERIES, SQL, query, table  # noqa: F401

AS_OF = "1996-06-01"
NORM = "trim(regexp_replace(strip_accents(lower(translate({x}, '’‘ʼ′`´', ''''''''''''''))), '\\s+', ' ', 'g'))"
KEY = "trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def norm_sql(x: str) -> str:
    return NORM.format(x=f"coalesce({x}, '')")


def key_sql(x: str) -> str:
    return KEY.format(x=x)


# ---- text functions ----


@query(f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents")
def text_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, {key_sql('text')} AS match_key FROM documents")
def match_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.match_key(F.col("text")).alias("match_key"))


STOP = ", ".join(f"'{w}'" for w in text.FRENCH_STOPWORDS)


@query(f"""WITH t AS (SELECT doc_id, lower(text) AS low, regexp_extract_all(lower(text), '[a-zA-Z]+') AS tokens FROM documents),
h AS (SELECT doc_id, low, len(tokens) AS n, len(list_filter(tokens, lambda x: x IN ({STOP}))) AS hits FROM t)
SELECT doc_id, CASE WHEN n = 0 THEN NULL WHEN hits >= 3 OR (regexp_matches(low, '[{text.FRENCH_ACCENTS}]') AND hits >= 1) THEN 'fr' ELSE 'en' END AS language FROM h""")
def language_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.detect_language(F.col("text")).alias("language"))


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(text, '{text.EMAIL}', '[REDACTED_EMAIL]', 'g'), '{text.PHONE}', '[REDACTED_PHONE]', 'g') AS clean FROM documents""")
def pii_scrub(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.scrub_pii(F.col("text")).alias("clean"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS safe FROM documents""")
def html_escaped(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.html_escape(F.col("text")).alias("safe"))


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE coalesce(nullif(regexp_extract(substr(text, 1, 117), '^(.*\S)\s', 1, 's'), ''), substr(text, 1, 117)) || '...' END AS short FROM documents""")
def truncated(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 120).alias("short"))


# ---- terms and rules, over documents as notices ----

# Terms that occur in the test tables' invented language.
DATA_TERMS = {
    "direct": ["mit license", "apache license", "password", "ederwh"], "domain": ["erreor", "tion", "enched", "onthe", "version 2", "schaf"], "transform": ["hation", "reing", "tiwh", "deleux", "hation"],
    "it": ["wherer", "shti", "pour", "andth"], "allow_title": ["thand", "enes"], "allow_product": ["onhere"], "portal": ["akia", "akey"],
    "supply": ["all rights reserved", "estou"], "hardware": ["ndtion", "éelle"], "award": ["none"], "negative": ["oution", "esha", "aux"],
}
DATA_CONFIG = rules.RuleConfig(terms=DATA_TERMS, staffing_patterns=(r"\bin\b", r"\bder\b"), portal_words=("password", "ederwh"), max_close_days=180, min_score=70)


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notices: the first line as title, codes and dates from the numbers."""
    line = F.element_at(F.split("text", "\n"), 1)
    d = table(spark, sf_dir, "documents")
    code = F.element_at(F.array(*[F.lit(c) for c in ("43211500", "81111500", "72101500", "80101507", "50000000")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(
        "doc_id", "n_chars", line.alias("title"), F.col("text").alias("description"), F.lit("").alias("notice_type_fr"),
        F.when(F.col("doc_id") % 7 == 0, "Request for Information").when(F.col("doc_id") % 31 == 0, "ACAN").otherwise("Request for Proposal").alias("notice_type_en"),
        F.when(F.col("doc_id") % 11 == 0, "*GD").otherwise("*SRV").alias("procurement_category"), F.array(code).alias("unspsc"), F.timestamp_add("DAY", (F.col("n_chars") % 400).cast("int"), F.lit(AS_OF).cast("timestamp")).alias("close_at"),
    )


def term_sql(x: str, term: str) -> str:
    return f"regexp_matches({x}, '{terms.pattern(term)}')"


def hits_sql(x: str, words: list[str]) -> str:
    parts = ", ".join(f"CASE WHEN {term_sql(x, w)} THEN '{w}' END" for w in words)
    return f"list_filter([{parts}], lambda t: t IS NOT NULL)"


def any_sql(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(term_sql(x, w) for w in words) + ")"


def cascade_sql() -> str:
    t = DATA_TERMS
    weak = "len(list_filter(direct, lambda x: x NOT IN ('password', 'ederwh'))) = 0 AND NOT contains(title, 'password') AND NOT contains(title, 'ederwh') AND NOT allowed AND (len(portal) > 0 OR (len(dom) = 0 AND len(it) = 0))"
    reasons = [
        ("exclude_award_notice", rf"{any_sql('kind', t['award'])} OR regexp_matches(title, '^(?:acan|pac)\b')"),
        ("exclude_supply_arrangement", any_sql("body", t["supply"])),
        ("exclude_staffing", r"NOT is_direct AND regexp_matches(title, '\bin\b|\bder\b')"),
        ("exclude_negative_title", f"NOT is_direct AND {any_sql('title', t['negative'])} AND NOT allowed"),
        ("exclude_non_it_unspsc", "NOT is_direct AND regexp_matches(code, '^(?:72|73|76|78|85|90)')"),
        ("exclude_goods_or_hardware", f"NOT is_direct AND (doc_id % 11 = 0 OR {any_sql('body', t['hardware'])})"),
        ("exclude_no_erp_domain", "NOT is_direct AND len(dom) = 0 AND NOT allowed AND NOT (len(tr) > 0 AND (it_code OR len(it) > 0))"),
        ("exclude_no_transformation", "NOT is_direct AND len(tr) = 0 AND NOT contains(kind, 'request for information') AND NOT allowed"),
        ("exclude_no_it_context", "NOT is_direct AND NOT it_code AND len(it) = 0 AND NOT allowed"),
        ("exclude_far_future_close", "NOT is_direct AND n_chars % 400 > 180"),
    ]
    listed = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in reasons)
    return f"""n AS (SELECT doc_id, n_chars, string_split(text, chr(10))[1] AS raw, text,
  CASE WHEN doc_id % 7 = 0 THEN 'Request for Information' WHEN doc_id % 31 = 0 THEN 'ACAN' ELSE 'Request for Proposal' END AS ntype,
  CASE WHEN doc_id % 11 = 0 THEN '*GD' ELSE '*SRV' END AS cat, ['43211500', '81111500', '72101500', '80101507', '50000000'][doc_id % 5 + 1] AS code FROM documents),
b AS (SELECT doc_id, n_chars, code, {norm_sql('raw')} AS title, {norm_sql('ntype')} AS kind, {norm_sql("raw || ' ' || text || ' ' || ntype || ' ' || cat")} AS body FROM n),
h AS (SELECT *, {hits_sql('body', t['direct'])} AS direct, {hits_sql('body', t['domain'])} AS dom, {hits_sql('body', t['transform'])} AS tr, {hits_sql('body', t['it'])} AS it,
  {hits_sql('body', t['portal'])} AS portal, ({any_sql('title', t['allow_title'])} OR {any_sql('title', t['allow_product'])}) AS allowed, len({hits_sql('title', t['allow_title'])}) + len({hits_sql('title', t['allow_product'])}) AS n_allowed,
  regexp_matches(code, '^(?:43|8111|8112|8113|8114)') OR code = '80101507' AS it_code FROM b),
d AS (SELECT *, len(direct) > 0 AND NOT ({weak}) AS is_direct FROM h),
c AS (SELECT *, list_filter([{listed}], lambda r: r IS NOT NULL) AS reasons,
  CASE WHEN is_direct THEN 100 + least(20, 5 * greatest(len(direct) - 1, 0)) ELSE least(95, 55 + (CASE WHEN it_code THEN 15 ELSE 0 END) + least(20, 7 * len(dom)) + least(15, 5 * len(tr)) + least(10, 4 * len(it))) END AS rule_score FROM d)"""


CASCADE = cascade_sql()


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.cascade(notices(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), DATA_CONFIG)


@query(f"WITH {CASCADE} SELECT doc_id, array_to_string(direct, ',') AS direct, array_to_string(dom, ',') AS domain_terms, array_to_string(tr, ',') AS transform_terms, array_to_string(it, ',') AS it_terms FROM c")
def term_hits(spark, sf_dir):
    d = decided(spark, sf_dir)
    return d.select("doc_id", *[F.array_join(f"{k}_hits", ",").alias(a) for k, a in (("direct", "direct"), ("domain", "domain_terms"), ("transform", "transform_terms"), ("it", "it_terms"))])


@query(f"WITH {CASCADE} SELECT term, count(*) AS docs FROM (SELECT unnest(list_distinct(list_concat(direct, dom, tr, it))) AS term FROM c) GROUP BY term")
def term_hit_counts(spark, sf_dir):
    d = decided(spark, sf_dir)
    return d.select(F.explode(F.array_distinct(F.concat("direct_hits", "domain_hits", "transform_hits", "it_hits"))).alias("term")).groupBy("term").agg(F.count("*").alias("docs"))


@query(f"WITH {CASCADE} SELECT doc_id, is_direct, reasons[1] AS reject_reason, array_to_string(reasons, ',') AS reasons, CAST(rule_score AS INTEGER) AS rule_score FROM c")
def rule_cascade(spark, sf_dir):
    return decided(spark, sf_dir).select("doc_id", "is_direct", "reject_reason", F.array_join("reject_reasons", ",").alias("reasons"), "rule_score")


@query(f"WITH {CASCADE} SELECT reasons[1] AS reject_reason, count(*) AS rows FROM c WHERE len(reasons) > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def reject_report(spark, sf_dir):
    return rules.reason_counts(decided(spark, sf_dir))


FINAL = f"""{CASCADE}, s AS (SELECT *, least(120, CAST(round_even(100.0 * (n_chars % 100) / 100, 0) AS INTEGER) + (CASE WHEN it_code OR len(it) > 0 THEN 8 ELSE 0 END) + least(18, 6 * len(dom)) + least(15, 5 * len(tr)) + (CASE WHEN n_allowed > 0 THEN 6 ELSE 0 END)) AS semantic_score FROM c),
f AS (SELECT *, CASE WHEN is_direct THEN greatest(100, greatest(semantic_score, rule_score) + least(20, 5 * greatest(len(direct) - 1, 0))) ELSE greatest(semantic_score, rule_score) END AS score FROM s)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no vectors of documents; similarities that differ from row to row come from n_chars."""
    return rules.final_score(rules.with_evidence(decided(spark, sf_dir).withColumn("similarity", F.col("n_chars") % 100 / 100)), DATA_CONFIG)


@query(f"WITH {FINAL} SELECT doc_id, CAST(semantic_score AS INTEGER) AS semantic_score, CAST(score AS INTEGER) AS score FROM f WHERE len(reasons) = 0 AND (is_direct OR score >= 70) ORDER BY score DESC, doc_id LIMIT 50")
def final_score_topn(spark, sf_dir):
    return scored(spark, sf_dir).filter("reject_reason IS NULL").orderBy(F.col("score").desc(), "doc_id").limit(50).select("doc_id", F.col("semantic_score").cast("int").alias("semantic_score"), F.col("score").cast("int").alias("score"))


@query(f"WITH {FINAL} SELECT doc_id, reasons[1] AS reject_reason FROM f WHERE len(reasons) = 1 AND reasons[1] NOT IN ('exclude_award_notice', 'exclude_supply_arrangement', 'exclude_staffing') ORDER BY doc_id LIMIT 20")
def watchlist(spark, sf_dir):
    return rules.watchlist(decided(spark, sf_dir), [F.col("doc_id")]).select("doc_id", "reject_reason")


@query(f"WITH {CASCADE} SELECT doc_id, reasons[1] AS reject_reason FROM c WHERE len(reasons) = 1")
def near_miss_single_reason(spark, sf_dir):
    return rules.near_misses(decided(spark, sf_dir)).select("doc_id", "reject_reason")


@query(f"""WITH {FINAL} SELECT doc_id, 'kept' AS decision, CAST(score AS INTEGER) AS score, NULL AS reason FROM f WHERE len(reasons) = 0 AND (is_direct OR score >= 70)
UNION ALL SELECT doc_id, 'rejected', NULL, CASE WHEN len(reasons) > 0 THEN reasons[1] ELSE 'exclude_below_score_threshold' END FROM f WHERE NOT (len(reasons) = 0 AND (is_direct OR score >= 70))""")
def decisions_append(spark, sf_dir):
    return state.decisions(scored(spark, sf_dir), "doc_id")


# ---- state: orders by customer as versions of records ----

VERSIONS = "v AS (SELECT o_custkey AS key, o_orderkey AS version, o_orderdate AS seen_at, o_orderpriority AS attachment_hash FROM orders)"
LATEST = "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seen_at DESC, version DESC) AS n FROM {x}) WHERE n = 1"
CUT = "1997-01-01"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("seen_at"), F.col("o_orderpriority").alias("attachment_hash"))


def latest(df: DataFrame) -> DataFrame:
    return state.latest_per_key(df, "key", [F.col("seen_at").desc(), F.col("version").desc()])


@query(f"WITH {VERSIONS} {LATEST.format(x='v')}")
def latest_per_key(spark, sf_dir):
    return latest(versions(spark, sf_dir))


SPLIT = f"{VERSIONS}, old AS ({LATEST.format(x=f'''(SELECT * FROM v WHERE seen_at < TIMESTAMP '{CUT}')''')}), new AS ({LATEST.format(x=f'''(SELECT * FROM v WHERE seen_at >= TIMESTAMP '{CUT}')''')})"


@query(f"""WITH {SPLIT}
SELECT n.key, array_to_string(list_filter([CASE WHEN o.key IS NULL THEN 'new' END, CASE WHEN o.key IS NOT NULL AND n.version > o.version THEN 'amendment' END,
  CASE WHEN o.key IS NOT NULL AND n.seen_at <> o.seen_at THEN 'close_date_changed' END, CASE WHEN o.key IS NOT NULL AND n.attachment_hash <> o.attachment_hash THEN 'new_attachment' END], lambda x: x IS NOT NULL), ',') AS events
FROM new n LEFT JOIN old o ON n.key = o.key""")
def event_detection(spark, sf_dir):
    v = versions(spark, sf_dir)
    shape = lambda d: d.select("key", F.col("version").alias("amendment"), F.col("seen_at").alias("close_date"), "attachment_hash")
    found = state.changes(shape(latest(v.filter(F.col("seen_at") >= F.lit(CUT).cast("timestamp")))), shape(latest(v.filter(F.col("seen_at") < F.lit(CUT).cast("timestamp")))), "key")
    return found.select("key", F.array_join("events", ",").alias("events"))


@query(f"""WITH {SPLIT} SELECT coalesce(n.key, o.key) AS key, coalesce(o.seen_at, n.seen_at) AS first_seen, CASE WHEN n.key IS NOT NULL THEN n.seen_at ELSE o.seen_at END AS last_seen, greatest(n.version, o.version) AS amendment, coalesce(n.attachment_hash, o.attachment_hash) AS attachment_hash
FROM old o FULL JOIN new n ON n.key = o.key""")
def state_upsert(spark, sf_dir):
    v = versions(spark, sf_dir)
    shape = lambda d: d.select("key", F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"), F.col("version").alias("amendment"), "attachment_hash")
    old, new = (shape(latest(v.filter(c))) for c in (F.col("seen_at") < F.lit(CUT).cast("timestamp"), F.col("seen_at") >= F.lit(CUT).cast("timestamp")))
    return state.upsert(old, new, "key", keep_first=["first_seen"], keep_old_if_null=["attachment_hash"], greatest=["amendment"])


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS sightings FROM events GROUP BY user_id")
def first_last_seen(spark, sf_dir):
    return state.first_last_seen(table(spark, sf_dir, "events"), "user_id", "ts")


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-25')")
def incremental_since(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    runs = e.filter((F.col("event_type") == "purchase") & (F.col("ts") < F.lit("2024-01-25").cast("timestamp"))).select(F.lit("ok").alias("status"), F.lit(False).alias("dry_run"), F.col("ts").alias("finished_at"))
    cursor = state.last_ok_run(runs).first()["cursor"]
    return state.since(e, "ts", F.lit(cursor)).select("event_id", "ts")


@query("""WITH a AS (SELECT c_custkey AS key, 'a' AS origin, c_acctbal AS score FROM customer WHERE c_acctbal > 5000), b AS (SELECT c_custkey AS key, 'b' AS origin, c_acctbal AS score FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT * FROM a UNION ALL SELECT * FROM b WHERE key NOT IN (SELECT key FROM a)""")
def union_first_wins(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    shape = lambda d, o: d.select(F.col("c_custkey").alias("key"), F.lit(o).alias("origin"), F.col("c_acctbal").alias("score"))
    return state.union_first([shape(c.filter("c_acctbal > 5000"), "a"), shape(c.filter("c_mktsegment = 'BUILDING'"), "b")], "key", ["key"])


@query("SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT s_suppkey + 1000000 AS key, s_name AS name FROM supplier")
def review_edits(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"))
    more = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).alias("key"), F.col("s_name").alias("name"))
    return state.append_absent(state.remove_key(c, gone, "key"), more, "key")


# ---- vectors ----


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e),
c AS (SELECT label, list(m ORDER BY i) AS w FROM (SELECT label, i, avg(x) AS m FROM p GROUP BY label, i) GROUP BY label),
s AS (SELECT vec_id, CAST(c.label AS VARCHAR) AS bucket, least(1.0, greatest(0.0, list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))))) AS sim FROM e CROSS JOIN c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, bucket) AS n FROM s)
SELECT vec_id, CASE WHEN sim > 0 THEN bucket ELSE 'unknown' END AS bucket, round(sim, 4) AS similarity FROM r WHERE n = 1""")
def cosine_best_bucket(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    found = vectors.best_bucket(e, "vec_id", "embedding", vectors.centroids(e, "label", "embedding"), "label", "centroid")
    return found.select("vec_id", "bucket", F.round("similarity", 4).alias("similarity"))


KEYWORDS = {"roman": ["pour", "dans", "los", "que"], "english": ["the", "and", "ing", "tion"], "german": ["und", "der", "sch"]}


@query(f"""WITH t AS (SELECT doc_id, {norm_sql('text')} AS x FROM documents), s AS (SELECT doc_id, unnest([{", ".join("{'turn': " + str(k) + ", 'bucket': '" + n + "', 'sim': len(list_filter(" + str(w) + ", lambda q: contains(x, q)))::DOUBLE / " + str(len(w)) + "}" for k, (n, w) in enumerate(KEYWORDS.items()))}], recursive := true) FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, turn) AS n FROM s) SELECT doc_id, CASE WHEN sim > 0 THEN bucket ELSE 'unknown' END AS bucket, sim AS similarity FROM r WHERE n = 1""")
def keyword_similarity(spark, sf_dir):
    best = vectors.best_keywords(text.normalize_text(F.col("text")), KEYWORDS)
    return table(spark, sf_dir, "documents").select("doc_id", best.alias("b")).select("doc_id", "b.bucket", "b.similarity")


@query("SELECT 'known' AS part, vec_id FROM embeddings WHERE vec_id IN (SELECT vec_id FROM embeddings WHERE label < 5) UNION ALL SELECT 'missing' AS part, vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 5)")
def embedding_cache_split(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    known, missing = lookups.split_by_cache(e, e.filter("label < 5"), ["vec_id", "label"])
    return known.select(F.lit("known").alias("part"), "vec_id").unionByName(missing.select(F.lit("missing").alias("part"), "vec_id"))


# ---- long documents ----

LINES = "p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), l AS (SELECT doc_id, pos, trim(raw) AS line FROM p WHERE trim(raw) <> '')"


@query(f"""WITH {LINES}, c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, count(*) OVER (PARTITION BY doc_id, line) AS seen FROM l),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM c WHERE NOT (n >= 20 AND seen >= 3 AND length(line) BETWEEN 12 AND 180) GROUP BY doc_id)
SELECT d.doc_id, coalesce(body, '') AS text FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id""")
def normalize_extracted_text(spark, sf_dir):
    return documents.normalize_extracted(table(spark, sf_dir, "documents"), "doc_id")


@query(f"""WITH {LINES} SELECT source, line, count(*) AS pages FROM (SELECT DISTINCT d.source, l.doc_id, line FROM l JOIN documents d ON d.doc_id = l.doc_id) GROUP BY source, line HAVING count(*) >= 2""")
def repeated_lines(spark, sf_dir):
    return documents.repeated_lines(table(spark, sf_dir, "documents"), "source", "doc_id")


@query(f"""WITH p AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), l AS (SELECT source, doc_id, pos, trim(raw) AS line FROM p WHERE trim(raw) <> ''),
o AS (SELECT source, line FROM l GROUP BY ALL HAVING count(*) > 1), k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM l WHERE (source, line) NOT IN (SELECT (source, line) FROM o) GROUP BY doc_id),
n AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT d.source, d.doc_id, CASE WHEN n < 2 THEN trim(text) ELSE coalesce(body, '') END AS text FROM documents d JOIN n ON n.source = d.source LEFT JOIN k ON k.doc_id = d.doc_id""")
def strip_page_lines(spark, sf_dir):
    """Sources as documents, their documents as pages."""
    return documents.strip_page_lines(table(spark, sf_dir, "documents"), "source", "doc_id")


HEADINGS = "|".join(documents.HEADING_TERMS)
# The documents' invented words hold no heading: a third get headings with terms, a third others, a third stay as they are.
HEADED = "headed AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Scope of work:' || chr(10) || replace(text, '. ', '.' || chr(10) || '2.1 Key dates' || chr(10)) WHEN 1 THEN replace(text, '. ', '.' || chr(10) || 'Note:' || chr(10)) ELSE text END AS text FROM documents)"


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = lambda line: F.replace("text", F.lit(". "), F.lit(f".\n{line}\n"))
    titled = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Scope of work:\n"), more("2.1 Key dates"))).when(F.col("doc_id") % 3 == 1, more("Note:")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", titled.alias("text"))


SECTIONS = rf"""{HEADED}, {LINES.replace("FROM documents", "FROM headed")}, hd AS (SELECT *, length(line) <= 120 AND (regexp_matches(line, '^\d+(\.\d+)*\.?\s+\S') OR line LIKE '%:' OR (line = upper(line) AND line <> lower(line) AND length(line) > 4)) AS shaped FROM l),
hm AS (SELECT *, shaped AND regexp_matches(strip_accents(lower(line)), '{HEADINGS}') AS main, shaped AND line NOT LIKE '%.' AND len(regexp_split_to_array(line, '\s+')) <= 12 AS loose FROM hd), hb AS (SELECT *, bool_or(main) OVER (PARTITION BY doc_id) AS by_term FROM hm),
hs AS (SELECT *, sum((CASE WHEN by_term THEN main ELSE loose END)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM hb), ht AS (SELECT *, CASE WHEN by_term THEN s ELSE least(s, 8) END AS section FROM hs WHERE s >= 1),
hf AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, section) AS first FROM ht WHERE section <= 8),
sec AS (SELECT doc_id, section::BIGINT AS section, arg_min(line, pos) AS heading, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (pos > first), '') AS text, count(*) - 1 AS n_lines FROM hf GROUP BY doc_id, section)"""


@query(f"WITH {SECTIONS} SELECT doc_id, section, heading, text, n_lines, length(text)::BIGINT AS chars FROM sec")
def sectionize(spark, sf_dir):
    return documents.sectionize(headed(spark, sf_dir), "doc_id")


@query(f"""WITH {SECTIONS}, a AS (SELECT doc_id, string_agg(heading || CASE WHEN text = '' THEN '' ELSE chr(10) || text END, chr(10) || chr(10) ORDER BY section) AS x FROM sec GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN x IS NULL THEN trim(substr(d.text, 1, 4000)) WHEN length(x) <= 4000 THEN x ELSE coalesce(nullif(trim(regexp_extract(substr(x, 1, 4000), '^(.*)\\n', 1, 's')), ''), trim(substr(x, 1, 4000))) END AS excerpt FROM headed d LEFT JOIN a ON a.doc_id = d.doc_id""")
def section_excerpt(spark, sf_dir):
    return documents.section_excerpt(headed(spark, sf_dir), "doc_id")


MOST, OVERLAP = 1200, 150


def chunk_sql(source: str, keys: str) -> str:
    """CTEs up to ck ({keys}, chunk, start, stop, text): the chunks of source's texts, by the rule."""
    backwards = f"position(' ' IN translate(reverse(substr(text, start + 1, {MOST})), chr(10), ' '))"
    step = f"SELECT *, CASE WHEN {backwards} > 0 AND length(substr(text, start + 1, {MOST})) - {backwards} > {int(MOST * 0.6)} THEN start + length(substr(text, start + 1, {MOST})) - {backwards} ELSE least(start + {MOST}, n) END AS stop"
    return f"""ct AS (SELECT {keys}, text, length(text) AS n FROM {source} WHERE length(text) > 0), cw AS ({step} FROM (SELECT *, 0 AS start FROM ct) UNION ALL {step} FROM (SELECT {keys}, text, n, greatest(stop - {OVERLAP}, start + 1) AS start FROM cw WHERE stop < n)),
ck AS (SELECT {keys}, (row_number() OVER (PARTITION BY {keys} ORDER BY start) - 1)::INT AS chunk, start::INT AS start, stop::INT AS stop, regexp_replace(substr(text, start + 1, stop - start), '^\\s+|\\s+$', '', 'g') AS text FROM cw WHERE regexp_matches(substr(text, start + 1, stop - start), '\\S'))"""


CHUNKS = chunk_sql("documents", "doc_id")


@query(f"WITH RECURSIVE {CHUNKS} SELECT * FROM ck")
def chunk_text(spark, sf_dir):
    return documents.chunks(table(spark, sf_dir, "documents"), "doc_id", most=MOST, overlap=OVERLAP)


@query(f"""WITH RECURSIVE {SECTIONS}, src AS (SELECT doc_id, section, heading, text FROM sec UNION ALL SELECT doc_id, NULL, NULL, text FROM headed WHERE doc_id NOT IN (SELECT doc_id FROM sec)), {chunk_sql("src", "doc_id, section, heading")} SELECT * FROM ck""")
def section_chunks(spark, sf_dir):
    return documents.section_chunks(headed(spark, sf_dir), "doc_id", most=MOST, overlap=OVERLAP)


# Stand-ins for the vectors of prompts and chunks (no model is reachable): how often each letter occurs.
PROMPTS = {"requirements": "mandatory requirements and minimum criteria", "dates": "closing date, deadline and schedule", "evaluation": "evaluation method and rated criteria"}
LETTER_SQL = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (length({x}) - length(replace({x}, c, '')))::DOUBLE)"
PROMPT_SQL = " UNION ALL ".join(f"SELECT '{n}' AS name, {[float(t.count(c)) for c in vectors.LETTERS]}::DOUBLE[] AS w" for n, t in PROMPTS.items())
BOOST = f"(CASE WHEN regexp_matches(lower(text), '{'|'.join(documents.REQUIREMENT_WORDS)}') THEN 0.08 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '{'|'.join(documents.DATE_WORDS)}') OR regexp_matches(text, '{documents.DATE_HINT}') THEN 0.07 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '{'|'.join(documents.EVALUATION_WORDS)}') THEN 0.06 ELSE 0 END)::DOUBLE"
SCORED = f"""{CHUNKS}, cv AS (SELECT doc_id, chunk, text, {LETTER_SQL.format(x="lower(text)")} AS v FROM ck),
cs AS (SELECT doc_id, chunk, text, name, CASE WHEN list_dot_product(v, v) = 0 THEN 0 ELSE least(1.0, list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w)))) END AS sim FROM cv, ({PROMPT_SQL})),
cb AS (SELECT doc_id, chunk, any_value(text) AS text, max(sim) AS similarity, arg_max(name, (sim, -CASE name {" ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(sorted(PROMPTS)))} END)) AS best FROM cs GROUP BY doc_id, chunk),
sc AS (SELECT doc_id, chunk, text, CASE WHEN similarity > 0 THEN best END AS prompt, similarity, {BOOST} AS boost, round(least(1.0, similarity + {BOOST}), 4)::DOUBLE AS score FROM cb)"""
TOP = f"{SCORED}, ra AS (SELECT *, bool_or(score >= 0.06) OVER (PARTITION BY doc_id) AS good, row_number() OVER (PARTITION BY doc_id ORDER BY score >= 0.06 DESC, score DESC, chunk) AS rank FROM sc), tp AS (SELECT * FROM ra WHERE rank <= 6 AND (NOT good OR score >= 0.06))"


def scored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = spark.createDataFrame(list(PROMPTS.items()), "name string, text string").select("name", vectors.letter_vector(F.col("text")).alias("vector"))
    found = documents.chunks(table(spark, sf_dir, "documents"), "doc_id", most=MOST, overlap=OVERLAP)
    return documents.score_chunks(found.withColumn("vector", vectors.letter_vector(F.col("text"))), "vector", prompts)


@query(f"WITH RECURSIVE {SCORED} SELECT doc_id, chunk, prompt, round(similarity, 4) AS similarity, boost, score FROM sc")
def chunk_scores(spark, sf_dir):
    return scored_chunks(spark, sf_dir).select("doc_id", "chunk", "prompt", F.round("similarity", 4).alias("similarity"), "boost", "score")


@query(f"WITH RECURSIVE {TOP} SELECT doc_id, chunk, score, rank::INT AS rank FROM tp")
def retrieval_topk(spark, sf_dir):
    return documents.top_chunks(scored_chunks(spark, sf_dir), "doc_id").select("doc_id", "chunk", "score", "rank")


BUDGET = 3000


@query(f"""WITH RECURSIVE {TOP}, bl AS (SELECT doc_id, rank, trim('CHUNK ' || rank || chr(10) || trim(text)) AS block FROM tp),
fo AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS total, false AS over, []::VARCHAR[] AS parts FROM (SELECT DISTINCT doc_id FROM bl) UNION ALL
  SELECT doc_id, i + 1, CASE WHEN ends OR part = '' THEN total ELSE total + length(part) + 2 END, ends, CASE WHEN ends OR part = '' THEN parts ELSE list_append(parts, part) END FROM (SELECT *, over OR total >= {BUDGET} OR (length(block) > {BUDGET} - total AND {BUDGET} - total <= 20) AS ends,
    CASE WHEN length(block) <= {BUDGET} - total THEN block WHEN contains(substr(block, 1, {BUDGET} - total), chr(10)) THEN trim(regexp_extract(substr(block, 1, {BUDGET} - total), '^(.*)\\n', 1, 's')) ELSE trim(substr(block, 1, {BUDGET} - total)) END AS part
    FROM fo JOIN bl ON bl.doc_id = fo.doc_id AND bl.rank = fo.i + 1))
SELECT doc_id, arg_max(trim(array_to_string(parts, chr(10) || chr(10))), i) AS excerpt FROM fo GROUP BY doc_id""")
def retrieval_excerpt(spark, sf_dir):
    return documents.excerpt(documents.top_chunks(scored_chunks(spark, sf_dir), "doc_id"), "doc_id", "rank", budget=BUDGET)


# ---- requirements: document lines as items ----

ITEMS = f"{LINES}, i AS (SELECT doc_id, pos - 1 AS pos, line AS item, {key_sql('line')} AS k FROM l)"
BOILER = ", ".join(f"'{b}'" for b in requirements.BOILERPLATE)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.lines(table(spark, sf_dir, "documents"), "doc_id").withColumnRenamed("line", "item")


STARTS, NAMES = "|".join(requirements.BOILERPLATE_STARTS), ", ".join(f"'{n}'" for n in requirements.SHORT_NAMES)


@query(rf"""WITH {ITEMS}, w AS (SELECT *, length(item) AS n, regexp_extract_all(item, '[A-Za-z0-9]+') AS words FROM i),
r AS (SELECT *, CASE WHEN n < 8 OR (len(words) <= 2 AND n < 18) THEN NOT (regexp_matches(lower(item), '{requirements.STANDARDS}') OR lower(item) IN ({NAMES}) OR (contains(item, '/') AND n <= 12) OR regexp_matches(item, '^[A-Z0-9/\\-]{{2,10}}$'))
  ELSE len(words) <= 4 AND len(list_filter(words, lambda x: x = upper(x) AND x <> lower(x))) / greatest(len(words), 1) >= 0.6 END AS low FROM w)
SELECT doc_id, pos, low OR k IN ({BOILER}) OR k = '' OR regexp_matches(k, '^(?:{STARTS})') AS boilerplate, low AS low_requirement, n < 4 OR NOT regexp_matches(item, '\d') AS low_date, n < 6 OR (len(words) <= 2 AND n < 18) AS low_risk FROM r""")
def low_signal(spark, sf_dir):
    x = F.col("item")
    return items(spark, sf_dir).select("doc_id", "pos", requirements.is_boilerplate(x).alias("boilerplate"), requirements.low_signal_requirement(x).alias("low_requirement"), requirements.low_signal_date(x).alias("low_date"), requirements.low_signal_risk(x).alias("low_risk"))


@query(rf"""WITH {ITEMS}, e AS (SELECT i.*, d.text, {key_sql('d.text')} AS body, list_filter(string_split(k, ' '), lambda t: length(t) >= 4) AS tokens FROM i LEFT JOIN documents d ON d.doc_id = i.doc_id + 1)
SELECT doc_id, pos, k <> '' AND (contains(body, k) OR len(list_filter(regexp_extract_all(item, '({documents.DATE_HINT})', 1), lambda q: contains(body, trim(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g'))))) > 0
  OR (len(tokens) > 0 AND len(list_filter(tokens, lambda t: contains(body, t))) >= least(2, len(tokens)))) AS supported FROM e""")
def evidence_span(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") - 1).alias("doc_id"), "text")
    listed = table(spark, sf_dir, "documents").select("doc_id", documents.line_list(F.col("text")).alias("items")).join(d, "doc_id", "left")
    told = listed.select("doc_id", F.explode(evidence.with_support(F.col("items"), F.col("text"), lambda x: x["line"])).alias("x"))
    return told.select("doc_id", "x.item.pos", F.col("x.ok").alias("supported"))


@query(rf"""WITH {ITEMS}, w AS (SELECT *, length(item) AS n, regexp_extract_all(item, '[A-Za-z0-9]+') AS words FROM i),
r AS (SELECT *, CASE WHEN n < 8 OR (len(words) <= 2 AND n < 18) THEN NOT (regexp_matches(lower(item), '{requirements.STANDARDS}') OR lower(item) IN ({NAMES}) OR (contains(item, '/') AND n <= 12) OR regexp_matches(item, '^[A-Z0-9/\\-]{{2,10}}$'))
  ELSE len(words) <= 4 AND len(list_filter(words, lambda x: x = upper(x) AND x <> lower(x))) / greatest(len(words), 1) >= 0.6 END AS low FROM w),
s AS (SELECT *, low OR k IN ({BOILER}) OR k = '' OR regexp_matches(k, '^(?:{STARTS})') AS boiler FROM r), q AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN true ELSE false END AS same FROM s),
a AS (SELECT doc_id, item, pos, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS f FROM q WHERE NOT boiler AND same), b AS (SELECT doc_id, item, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS m FROM a WHERE f = 1),
c AS (SELECT doc_id, item, pos, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS f FROM q WHERE NOT boiler AND NOT (n < 6 OR (len(words) <= 2 AND n < 18))), d AS (SELECT doc_id, item, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS m FROM c WHERE f = 1)
SELECT o.doc_id, coalesce((SELECT string_agg(item, '|' ORDER BY pos) FROM b WHERE b.doc_id = o.doc_id AND m <= 8), '') AS requirements, coalesce((SELECT string_agg(item, '|' ORDER BY pos) FROM d WHERE d.doc_id = o.doc_id AND m <= 6), '') AS risks FROM (SELECT DISTINCT doc_id FROM i) o""")
def cleaned_summaries(spark, sf_dir):
    """Lines as items of a summary, the text (or none) as evidence."""
    listed = items(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("requirements"))
    d = listed.join(table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("evidence")), "doc_id")
    none = F.array().cast("array<string>")
    out = requirements.clean_summary(d.withColumns({"dates": none, "key_risks": F.col("requirements"), "attachments_used": none}))
    return out.select("doc_id", F.array_join("requirements", "|").alias("requirements"), F.array_join("key_risks", "|").alias("risks"))


@query(f"""WITH {ITEMS}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS n FROM i WHERE k <> ''), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS m FROM f WHERE n = 1)
SELECT doc_id, string_agg(item, '|' ORDER BY pos) AS items FROM g WHERE m <= 6 GROUP BY doc_id""")
def merge_requirements(spark, sf_dir):
    return requirements.merged_items(items(spark, sf_dir), "doc_id", "pos", "item").select("doc_id", F.array_join("items", "|").alias("items"))


STAFF, SUBMIT, TECHNICAL = ("|".join(w) for w in (requirements.STAFFING_WORDS, requirements.SUBMISSION_WORDS, requirements.TECHNICAL_WORDS))


@query(rf"""WITH {ITEMS}, r AS (SELECT *, CASE WHEN regexp_matches(lower(item), '{STAFF}') THEN 'staffing' WHEN regexp_matches(lower(item), '{SUBMIT}') AND NOT regexp_matches(lower(item), '{TECHNICAL}') THEN 'submission' ELSE 'technical' END AS class FROM i),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item ORDER BY pos) AS n FROM r WHERE class <> 'staffing'), q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, class ORDER BY pos) AS rank FROM o WHERE n = 1)
SELECT doc_id, class, CAST(rank AS INTEGER) AS rank, item FROM q WHERE rank <= CASE WHEN class = 'submission' THEN 1 ELSE 2 END""")
def requirement_routing(spark, sf_dir):
    return requirements.routed(items(spark, sf_dir), "doc_id", "pos", "item")


# ---- links and caches: pages as attachments ----


@query(r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', ['scheme', 'host', 'path']) AS p, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages),
s AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: regexp_matches(x, '=.'))) AS pairs FROM u)
SELECT page_id, lower(p.scheme) || '://' || lower(regexp_replace(p.host, '^.*@', '')) || p.path || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END AS url_norm, string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1] AS file_name FROM s""")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url_norm"), urls.file_name(F.col("url")).alias("file_name"))


@query(r"""SELECT page_id, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ' ') AS links FROM (SELECT page_id, list_transform(regexp_extract_all(url || ' see ' || url || '). ' || html, 'https?://[^\s<>"'']+'), lambda u: regexp_replace(u, '[).,;\]]+$', '')) AS m FROM pages)""")
def url_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(urls.extract_urls(F.concat("url", F.lit(" see "), "url", F.lit("). "), "html")), " ").alias("links"))


@query("SELECT page_id, sha256(url || '|' || sha256(html) || '|' || string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1] || '|' || length(html)) AS fingerprint FROM pages")
def fingerprint(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    none = F.lit(None).cast("string")
    return p.select("page_id", urls.fingerprint(F.col("url"), none, none, urls.file_name(F.col("url")), F.char_length("html"), F.sha2("html", 256)).alias("fingerprint"))


CACHE = """c AS (SELECT url, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'e' || (page_id % 5) END AS etag, CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'm' || (page_id % 2) END AS last_modified, sha256(html) AS content_hash, page_id AS fetched_at, page_id AS fingerprint FROM pages WHERE page_id % 2 = 0),
i AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'e' || (page_id % 5) END AS etag, CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'm' || (page_id % 2 + page_id % 7 // 6) END AS last_modified, sha256(html) AS content_hash FROM pages)"""


@query(f"""WITH {CACHE}, m AS (SELECT i.page_id, max_by(c.fingerprint, c.fetched_at) AS f FROM i JOIN c ON i.url = c.url AND i.etag IS NOT DISTINCT FROM c.etag AND i.last_modified IS NOT DISTINCT FROM c.last_modified GROUP BY 1),
b AS (SELECT i.page_id, max_by(c.fingerprint, c.fetched_at) AS f FROM i JOIN c ON i.url = c.url AND i.content_hash = c.content_hash GROUP BY 1)
SELECT i.page_id, coalesce(m.f, b.f) AS fingerprint, CASE WHEN m.f IS NOT NULL THEN 'meta' WHEN b.f IS NOT NULL THEN 'content' END AS found_by FROM i LEFT JOIN m ON m.page_id = i.page_id LEFT JOIN b ON b.page_id = i.page_id""")
def cache_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    etag = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("e"), (F.col("page_id") % 5).cast("string")))
    modified = lambda more: F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("m"), (F.col("page_id") % 2 + more).cast("string")))
    cache = p.filter("page_id % 2 = 0").select("url", etag.alias("etag"), modified(0).alias("last_modified"), F.sha2("html", 256).alias("content_hash"), F.col("page_id").alias("fetched_at"), F.col("page_id").alias("fingerprint"))
    wanted = p.select("page_id", "url", etag.alias("etag"), modified(F.floor(F.col("page_id") % 7 / 6)).alias("last_modified"), F.sha2("html", 256).alias("content_hash"))
    return lookups.cached_by_meta(wanted, cache).select("page_id", "fingerprint", "found_by")


@query()
def html_text_extract(spark, sf_dir):
    return files.html_text(table(spark, sf_dir, "pages")).select("page_id", "title", "text")


# ---- reports ----

FLAGS = "SELECT event_type <> 'login' AS has_attachment, value > 20 AS has_signal, value > 50 AS has_requirement, value > 70 AS has_date, value < 5 AS low_signal, user_id % 3 AS summaries, user_id % 2 AS failures, ts FROM events"
COVER = """SELECT count(*) AS notices, count_if(has_attachment) AS with_attachment, count_if(has_signal) AS with_signal, count_if(has_requirement) AS with_requirement, count_if(has_date) AS with_date, CAST(coalesce(sum(summaries), 0) AS BIGINT) AS summaries,
CAST(coalesce(sum(failures), 0) AS BIGINT) AS failures, count_if(low_signal) AS low_signals FROM ({x})"""
RATED = "SELECT *, CASE WHEN notices = 0 THEN 0 ELSE round(with_signal / notices * 100, 2) END AS coverage_rate, CASE WHEN with_attachment = 0 THEN 0 ELSE round(with_signal / with_attachment * 100, 2) END AS signal_rate, CASE WHEN with_attachment = 0 THEN 0 ELSE round(low_signals / with_attachment * 100, 2) END AS low_signal_rate FROM ({x})"
NOW = "2024-01-20"


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select((F.col("event_type") != "login").alias("has_attachment"), (v > 20).alias("has_signal"), (v > 50).alias("has_requirement"), (v > 70).alias("has_date"), (v < 5).alias("low_signal"), (F.col("user_id") % 3).alias("summaries"), (F.col("user_id") % 2).alias("failures"), "ts")


@query(RATED.format(x=COVER.format(x=FLAGS)))
def coverage_stats(spark, sf_dir):
    return reports.coverage(flagged(spark, sf_dir))


def window_sql(back: int, to: int) -> str:
    return RATED.format(x=COVER.format(x=f"SELECT * FROM ({FLAGS}) WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL {back} DAY AND ts < TIMESTAMP '{NOW}' - INTERVAL {to} DAY"))


@query(f"""WITH a AS ({window_sql(7, 0)}), b AS ({window_sql(14, 7)}) SELECT m.metric, m.cur AS current, coalesce(m.prev, 0) AS previous, round(m.cur - coalesce(m.prev, 0), 2) AS delta
FROM (SELECT unnest([{", ".join("{'metric': '" + r + "', 'cur': a." + r + "::DOUBLE, 'prev': b." + r + "::DOUBLE}" for r in reports.RATES)}]) AS m FROM a, b)""")
def weekly_delta(spark, sf_dir):
    f, now = flagged(spark, sf_dir), F.lit(NOW).cast("timestamp")
    return reports.weekly_delta(reports.coverage(reports.between(f, "ts", now, 7)), reports.coverage(reports.between(f, "ts", now, 14, 7)))


@query(f"SELECT o_orderkey AS key, o_orderdate AS close_at, CAST(floor(epoch(o_orderdate - TIMESTAMP '{AS_OF}') / 86400) AS BIGINT) AS days_left FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}' AND o_orderdate <= TIMESTAMP '{AS_OF}' + INTERVAL 7 DAY ORDER BY o_orderdate, o_orderkey LIMIT 15")
def upcoming_closes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("close_at"))
    return reports.upcoming(o, "close_at", F.lit(AS_OF).cast("timestamp"))


@query("SELECT CAST(ts AS DATE) AS date, count(*) AS rows FROM events GROUP BY 1")
def counts_by_date(spark, sf_dir):
    return reports.counts_by_date(table(spark, sf_dir, "events"), "ts")


@query("SELECT c_custkey, c_name FROM customer WHERE (contains(lower(c_name), '42') OR contains(lower(c_mktsegment), '42')) AND c_acctbal >= 100")
def ui_filter(spark, sf_dir):
    return reports.searched(table(spark, sf_dir, "customer"), "42", ["c_name", "c_mktsegment"], least=100, score="c_acctbal").select("c_custkey", "c_name")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS place FROM a WHERE n <= 2)
SELECT o_custkey, o_orderkey, CAST(place AS INTEGER) AS place FROM b WHERE place <= 6""")
def capped_notes(spark, sf_dir):
    return reports.capped(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey", ["o_orderkey"], 2, 6).select("o_custkey", "o_orderkey", "place")


@query("SELECT event_type AS arm, count(*) AS rows, count_if(value > 50) AS with_signal, round(avg(user_id % 7), 2) AS mean_requirements, round(avg(user_id % 4), 2) AS mean_dates FROM events GROUP BY 1")
def prompt_experiment(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), (F.col("value") > 50).alias("has_signal"), (F.col("user_id") % 7).alias("n_requirements"), (F.col("user_id") % 4).alias("n_dates"))
    return reports.experiment_summary(e, "arm")


@query("""WITH x AS (SELECT c_custkey AS key, c_name AS title, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'updated' END AS section, CASE WHEN c_custkey % 3 = 0 THEN 'New tender' ELSE 'Amendment posted; Close date changed' END AS labels FROM customer)
SELECT key, section, '<tr><td>' || replace(title, '&', '&amp;') || '</td><td>' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) || '</td><td>' || labels || '</td></tr>' AS html FROM x""")
def digest_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    events = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("new"))).otherwise(F.array(F.lit("amendment"), F.lit("close_date_changed")))
    return reports.digest_rows(c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("title"), F.floor("c_acctbal").alias("score"), events.alias("events")))


# ---- streaming, over the same operators ----


def streamed(spark: SparkSession, sf_dir: str, windows) -> DataFrame:
    """events read as a stream, counted by windows until all of it is read."""
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = streaming.work_folder(spark)
    return streaming.run_complete(windows(stream), streaming.SnapshotTable(spark, f"{folder}/windows"), f"{folder}/checkpoint")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return streamed(spark, sf_dir, streaming.tumbling_counts)


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, sid""")
def stream_session(spark, sf_dir):
    return streamed(spark, sf_dir, streaming.session_counts)


@query("WITH v AS (SELECT o_custkey AS key, o_orderdate AS seen_at, o_orderkey AS amendment FROM orders) SELECT key, arg_max(seen_at, (seen_at, amendment)) AS seen_at, arg_max(amendment, (seen_at, amendment)) AS amendment FROM v GROUP BY key")
def stream_upsert(spark, sf_dir):
    """orders as a stream, merged into keyed state batch by batch."""
    path = f"{sf_dir}/orders.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir).select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("seen_at"), F.col("o_orderkey").alias("amendment"))
    folder = streaming.work_folder(spark)
    return streaming.upsert_stream(stream, BucketedTable(spark, f"{folder}/state", "key"), [F.col("seen_at").desc(), F.col("amendment").desc()], f"{folder}/checkpoint", greatest=["amendment"])


@query(f"""WITH {SPLIT}, f AS (SELECT key, seen_at, version, attachment_hash FROM old) SELECT 0::BIGINT AS batch, key, 'new' AS events FROM f UNION ALL
SELECT 1, n.key, array_to_string(list_filter([CASE WHEN o.key IS NULL THEN 'new' END, CASE WHEN o.key IS NOT NULL AND n.version > o.version THEN 'amendment' END, CASE WHEN o.key IS NOT NULL AND n.seen_at <> o.seen_at THEN 'close_date_changed' END,
  CASE WHEN o.key IS NOT NULL AND n.attachment_hash <> o.attachment_hash THEN 'new_attachment' END], lambda x: x IS NOT NULL), ',') FROM new n LEFT JOIN old o ON n.key = o.key""")
def stream_changes(spark, sf_dir):
    """Orders in two batches, before and after a day: what each changes in the state of the one before, by key in a state store."""
    folder = streaming.work_folder(spark)
    found = keyed.run_keyed(keyed.keyed_changes(two_batches(spark, sf_dir, folder)), f"{folder}/events", f"{folder}/checkpoint")
    return found.filter(F.size("events") > 0).select("batch", "key", F.array_join("events", ",").alias("events"))


def two_batches(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Orders as a stream of notices in two files, those before a day and the others."""
    v = versions(spark, sf_dir).select("key", F.col("version").alias("amendment"), F.col("seen_at").cast("timestamp").alias("close_date"), "attachment_hash", F.col("seen_at").cast("timestamp").alias("seen_at"))
    for part in (F.col("seen_at") < F.lit(CUT).cast("timestamp"), F.col("seen_at") >= F.lit(CUT).cast("timestamp")):
        v.filter(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


# ---- more functions and lookups ----


@query(f"SELECT doc_id, trim(regexp_replace(lower(translate(text, '’‘ʼ′`´', '''''''''''''')), '\\s+', ' ', 'g')) AS soft, strip_accents(text) AS plain FROM documents")
def soft_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.soft_normalize(F.col("text")).alias("soft"), text.strip_accents(F.col("text")).alias("plain"))


@query(rf"""WITH {LINES} SELECT doc_id, pos - 1 AS pos, length(line) <= 120 AND (regexp_matches(line, '^\d+(\.\d+)*\.?\s+\S') OR line LIKE '%:' OR (line = upper(line) AND line <> lower(line) AND length(line) > 4)) AS heading FROM l""")
def heading_lines(spark, sf_dir):
    return documents.lines(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "pos", text.looks_like_heading(F.col("line")).alias("heading"))


def words_sql(words) -> str:
    return f"regexp_matches(lower(line), '{'|'.join(words)}')"


@query(rf"""WITH {LINES} SELECT doc_id, pos - 1 AS pos, (CASE WHEN {words_sql(documents.REQUIREMENT_WORDS)} THEN 0.08 ELSE 0 END + CASE WHEN {words_sql(documents.DATE_WORDS)} OR regexp_matches(line, '{documents.DATE_HINT}') THEN 0.07 ELSE 0 END
+ CASE WHEN {words_sql(documents.EVALUATION_WORDS)} THEN 0.06 ELSE 0 END)::DOUBLE AS boost FROM l""")
def keyword_boost(spark, sf_dir):
    return documents.lines(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "pos", documents.keyword_boost(F.col("line")).alias("boost"))


@query("SELECT event_id, props AS object FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.json_object(F.concat(F.lit("Here it is: "), "props", F.lit(" as asked."))).alias("object"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'cb:' || c_custkey WHEN c_custkey % 3 = 1 THEN 'cb:am:' || c_custkey ELSE 'src:' || c_name END AS stable_key, printf('%08d', c_custkey) || ',43' || c_nationkey AS codes,
sha256('["a' || c_nationkey || '","b"]') AS attachment_hash, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS first_text, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey::INT END AS amendment FROM customer""")
def record_keys(spark, sf_dir):
    from ..operators import notices as n

    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    s = key.cast("string")
    uid = F.when(key % 3 == 0, F.concat(F.lit("cb:"), s, F.lit(":am02"))).when(key % 3 == 1, F.concat(F.lit("cb:am:"), s, F.lit(":am1"))).otherwise("")
    nation = F.col("c_nationkey").cast("string")
    return c.select(
        "c_custkey", n.stable_key(uid, F.lit("src"), F.lit(" "), F.col("c_name")).alias("stable_key"), F.array_join(n.parse_codes(F.concat(F.lit("*"), F.lpad(s, 8, "0"), F.lit("\n* 43-"), nation)), ",").alias("codes"),
        n.attachment_hash(F.array(F.lit("b"), F.concat(F.lit(" a"), nation), F.lit("b "), F.lit(""))).alias("attachment_hash"),
        text.first_nonempty(F.when(key % 2 == 0, F.col("c_mktsegment")), F.lit("  "), F.col("c_name")).alias("first_text"), n.amendment(F.when(key % 5 != 0, F.concat(F.lit(" "), s)).otherwise("x1")).alias("amendment"),
    )


@query("SELECT o_orderkey, o_orderdate AS parsed, CAST(floor(epoch(o_orderdate - TIMESTAMP '1996-06-01') / 86400) AS BIGINT) AS days_left FROM orders")
def parse_dates(spark, sf_dir):
    forms = [F.date_format("o_orderdate", p) for p in ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")]
    raw = F.when(F.col("o_orderkey") % 2 == 0, forms[0]).otherwise(forms[1])
    d = table(spark, sf_dir, "orders").select("o_orderkey", numbers.parse_timestamp(raw).alias("parsed"))
    return d.withColumn("days_left", numbers.days_left(F.col("parsed"), F.lit(AS_OF).cast("timestamp")))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31'")
def seen_between(spark, sf_dir):
    at = lambda x: F.lit(x).cast("timestamp")
    return lookups.seen_between(table(spark, sf_dir, "orders"), "o_orderdate", at("1995-01-01"), at("1995-03-31")).select("o_orderkey")


@query("SELECT (user_id * 60)::BIGINT AS seconds FROM events WHERE event_type = 'purchase' ORDER BY ts DESC LIMIT 5")
def recent_durations(spark, sf_dir):
    """Purchases as runs: they end at their time and took as many minutes as the user's number."""
    started = F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.col("user_id").cast("int"))
    return state.recent_durations(table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.lit("ok").alias("status"), started.alias("started_at"), F.col("ts").alias("finished_at")))


@query("SELECT source AS url, max(n_chars) AS n_chars, arg_max(doc_id, (n_chars, -doc_id)) AS fingerprint FROM documents GROUP BY source")
def latest_cache_by_url(spark, sf_dir):
    return lookups.newest(table(spark, sf_dir, "documents"), ["source"], "n_chars", "doc_id").select(F.col("source").alias("url"), "n_chars", F.col("doc_id").alias("fingerprint"))


@query("""WITH c AS (SELECT 'k' || n_nationkey || ':am1' AS k, n_name AS v FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'k' || n_nationkey AS k, 'plain ' || n_name AS v FROM nation WHERE n_nationkey % 3 = 0)
SELECT c_custkey, coalesce(a.v, b.v) AS v FROM customer LEFT JOIN c a ON a.k = 'k' || c_nationkey || ':am1' LEFT JOIN c b ON b.k = 'k' || c_nationkey""")
def first_key_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.concat(F.lit("k"), F.col("n_nationkey").cast("string"))
    cache = n.filter("n_nationkey % 2 = 0").select(F.concat(k, F.lit(":am1")).alias("k"), F.col("n_name").alias("v")).unionByName(n.filter("n_nationkey % 3 = 0").select(k.alias("k"), F.concat(F.lit("plain "), "n_name").alias("v")))
    key = F.concat(F.lit("k"), F.col("c_nationkey").cast("string"))
    wanted = table(spark, sf_dir, "customer").select("c_custkey", F.concat(key, F.lit(":am1")).alias("a"), key.alias("b"))
    return lookups.first_key_lookup(wanted, cache, ["a", "b"], "k", "v").select("c_custkey", "v")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) AS x FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS y FROM a WHERE x <= 3)
SELECT o_orderkey FROM b WHERE y <= 4 ORDER BY o_custkey, o_orderpriority, o_orderkey LIMIT 500""")
def chunk_quota(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("item", F.concat_ws("/", F.lpad(F.col("o_custkey").cast("string"), 12, "0"), "o_orderpriority"))
    return documents.quota(o, "item", "o_custkey", "o_orderkey", 3, 4, 500).select("o_orderkey")


@query(f"""WITH {FINAL}, k AS (SELECT doc_id, score FROM f WHERE len(reasons) = 0 AND (is_direct OR score >= 70) ORDER BY score DESC, doc_id LIMIT 15), w AS (SELECT doc_id, score FROM f WHERE len(reasons) = 1 AND score >= 80)
SELECT doc_id, CAST(score AS INTEGER) AS score FROM (SELECT *, 0 AS t FROM k UNION ALL SELECT *, 1 AS t FROM w WHERE doc_id NOT IN (SELECT doc_id FROM k)) ORDER BY t, score DESC, doc_id LIMIT 20""")
def model_gate(spark, sf_dir):
    return rules.model_gate(scored(spark, sf_dir), "doc_id", [F.col("score").desc(), F.col("doc_id")]).select("doc_id", F.col("score").cast("int").alias("score"))


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS reviewed FROM customer")
def review_marks(spark, sf_dir):
    marks = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return lookups.with_review(table(spark, sf_dir, "customer"), marks, "c_custkey").select("c_custkey", "reviewed")


@query("SELECT event_id, CASE WHEN user_id % 4 = 0 THEN false ELSE true END AS signal FROM events")
def any_signal(spark, sf_dir):
    empty, some = F.array().cast("array<string>"), F.array(F.lit("x"))
    e = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("requirements"), empty, F.lit("dates"), F.when(F.col("user_id") % 4 == 0, empty).otherwise(some)).alias("m"))
    return e.select("event_id", numbers.any_signal(F.col("m")).alias("signal"))


from . import digest, flows, records  # noqa: E402, F401  register their queries

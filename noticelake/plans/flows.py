"""Queries over files written from the given tables, state tables, streams that close, and search by index."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import timedelta
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.folders import work_folder
from ..operators import search
from ..sources import files
from ..streaming import keyed, windows
from ..streaming.buckets import BucketedTable
from .catalog import CUT, LATEST, LINES, SPLIT, VERSIONS, latest, two_batches, versions
from .registry import SQL, query, table

# ---- files ----


@query("SELECT doc_id::VARCHAR AS doc_id, nullif(text, '') AS text, nullif(lang, '') AS lang, nullif(source, '') AS source FROM documents")
def csv_read_back(spark, sf_dir):
    """Documents written as CSV, with line feeds and quotes in cells, and read by block."""
    folder = work_folder(spark)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text", "source")
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").option("nullValue", "").csv(f"{folder}/csv")
    found = files.read_csv(spark, f"{folder}/csv", ["doc_id", "text", "lang", "source"])
    return found.select("doc_id", *[F.nullif(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_totalprice AS score, o_totalprice AS score_num, date_trunc('second', o_orderdate) AS close_dt FROM orders")
def export_read_back(spark, sf_dir):
    """Orders written as a CSV export and read with its dates and scores."""
    folder = work_folder(spark)
    table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("score"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("close")).write.option("header", True).csv(f"{folder}/csv")
    found = files.read_export(spark, f"{folder}/csv", ["close"])
    return found.select("o_orderkey", F.col("score").cast("double").alias("score"), "score_num", F.col("close_dt").cast("timestamp_ntz").alias("close_dt"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey FROM customer")
def zipped_csv_read_back(spark, sf_dir):
    """A zipped CSV of each nation's customers, packed in tasks, and all their rows."""

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("readme.txt", "no rows")
            z.writestr("rows.CSV", "﻿" + rows.to_csv(index=False))
        return pd.DataFrame({"content": [out.getvalue()]})

    zips = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey").groupBy("c_nationkey").applyInPandas(packed, "content binary")
    return files.zipped_rows(zips, ["c_custkey", "c_name", "c_nationkey"])


def office_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, content): documents as text files in two encodings, word files and archives, by turns."""
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    for frame in frames:
        out = []
        for doc, text in zip(frame["doc_id"], frame["text"]):
            kind, packed = doc % 4, io.BytesIO()
            if kind < 2:
                out.append((f"{doc}.txt", text.encode(("utf-8", "utf-16")[kind])))
                continue
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
                if kind == 2:
                    paragraphs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
                    z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{paragraphs}</w:body></w:document>')
                else:
                    z.writestr("a.txt", text)
                    z.writestr("inner.zip", b"")
            out.append((f"{doc}.{('docx', 'zip')[kind - 2]}", packed.getvalue()))
        yield pd.DataFrame(out, columns=["path", "content"])


@query(f"""WITH {LINES}, c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, count(*) OVER (PARTITION BY doc_id, line) AS seen FROM (SELECT doc_id, pos, line FROM l UNION ALL SELECT doc_id, 0, 'FILE: a.txt' FROM documents WHERE doc_id % 4 = 3)),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM c WHERE NOT (n >= 20 AND seen >= 3 AND length(line) BETWEEN 12 AND 180) GROUP BY doc_id)
SELECT d.doc_id || ['.txt', '.txt', '.docx', '.zip'][d.doc_id % 4 + 1] AS path, coalesce(body, '') AS text, false AS truncated, CASE WHEN d.doc_id % 4 = 3 THEN 1 ELSE 0 END AS skipped FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id""")
def extracted_documents(spark, sf_dir):
    """Documents as files of four kinds, and their texts out of these, normalised."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = files.extracted_texts(docs.mapInPandas(office_files, "path string, content binary"), files.WHOLE)
    return found.select("path", "text", "truncated", "skipped")


def written_log(spark: SparkSession, sf_dir: str) -> str:
    """Events as one log file, in the order of their ids. Returns its folder."""
    folder = work_folder(spark)
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARNING").otherwise("INFO")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" | "), level, F.lit(" | "), F.col("event_id").cast("string"))
    table(spark, sf_dir, "events").orderBy("event_id").coalesce(1).select(line.alias("value")).write.text(f"{folder}/log")
    return f"{folder}/log"


@query("SELECT row_number() OVER (ORDER BY event_id) AS line_no, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END AS level, event_id FROM events")
def log_numbered(spark, sf_dir):
    lines = files.log_lines(spark, written_log(spark, sf_dir))
    return lines.select("line_no", "level", F.regexp_extract("line", r"(\d+)$", 1).cast("long").alias("event_id"))


@query("SELECT count(*) AS errors FROM events WHERE event_type = 'error'")
def log_errors(spark, sf_dir):
    return files.count_errors(spark, written_log(spark, sf_dir)).select("errors")


@query("SELECT 'ERROR' AS level, event_id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 200")
def log_tail(spark, sf_dir):
    """The last errors of the log."""
    found = files.log_tail(spark, f"{written_log(spark, sf_dir)}/*.txt", "ERROR", 200)
    return found.select("level", F.regexp_extract("line", r"(\d+)$", 1).cast("long").alias("event_id"))


# ---- state tables ----


@query(SQL["state_upsert"])
def state_upsert_buckets(spark, sf_dir):
    """As state_upsert, in a table of buckets by key: the second batch rewrites the buckets of its own keys."""
    v = versions(spark, sf_dir)
    shape = lambda d: d.select("key", F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"), F.col("version").alias("amendment"), "attachment_hash")
    state = BucketedTable(spark, f"{work_folder(spark)}/state", "key")
    for batch, part in enumerate((F.col("seen_at") < F.lit(CUT).cast("timestamp"), F.col("seen_at") >= F.lit(CUT).cast("timestamp"))):
        state.merge(shape(latest(v.filter(part))), batch, keep_first=["first_seen"], keep_old_if_null=["attachment_hash"], greatest=["amendment"])
    return state.read()


# ---- streams that close ----

GRACE, BEHIND = 30, 7


@query(f"""WITH {VERSIONS}, n AS ({LATEST.format(x="v")}), w AS (SELECT max(seen_at) - INTERVAL {BEHIND} DAY AS mark FROM v)
SELECT key, seen_at AS close_date FROM n, w WHERE seen_at + INTERVAL {GRACE} DAY <= mark""")
def stream_closed_notices(spark, sf_dir):
    """Notices that left the state store by their timers, 30 days after they closed."""
    folder = work_folder(spark)
    changes = keyed.keyed_changes(two_batches(spark, sf_dir, folder), f"{BEHIND} days", timedelta(days=GRACE))
    found = keyed.run_keyed(changes, f"{folder}/events", f"{folder}/checkpoint")
    return found.filter(F.array_contains("events", "closed")).select("key", F.col("close_date").cast("timestamp_ntz").alias("close_date"))


#: How late some events come, and how long windows stay open.
LATE_BY, WAITS = 5, 2
ARRIVALS = f"a AS (SELECT *, ts + INTERVAL (CASE WHEN event_id % 7 = 0 THEN {LATE_BY} ELSE 0 END) DAY AS came FROM events), b AS (SELECT *, (datediff('day', TIMESTAMP '2024-01-01', came) // 7)::BIGINT AS batch FROM a)"


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of one file for each week in which they came: a seventh of them five days late."""
    folder = work_folder(spark)
    came = F.col("ts") + F.make_dt_interval(F.when(F.col("event_id") % 7 == 0, LATE_BY).otherwise(0))
    e = table(spark, sf_dir, "events").withColumn("week", F.floor(F.datediff(came, F.lit("2024-01-01").cast("date")) / 7)).withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "event_type", "week")
    for week in range(e.agg(F.max("week")).first()[0] + 1):
        e.filter(F.col("week") == week).drop("week").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(e.drop("week").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@query(f"""WITH {ARRIVALS}, m AS (SELECT batch, max(ts) AS newest FROM b GROUP BY batch), k AS (SELECT b.*, time_bucket(INTERVAL 1 DAY, ts) AS window_start,
  coalesce(time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(newest) FROM m WHERE m.batch <= b.batch - 2) - INTERVAL {WAITS} DAY, false) AS late FROM b)
SELECT window_start, event_type, count(*) FILTER (NOT late AND window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL {WAITS} DAY) AS on_time, count(*) FILTER (late) AS late FROM k GROUP BY ALL
HAVING count(*) FILTER (late OR window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL {WAITS} DAY) > 0""")
def stream_closed_windows(spark, sf_dir):
    """Daily windows in append mode: what they had when they closed, and the rows that came too late, from a table of their own."""
    stream, folder = arriving(spark, sf_dir), work_folder(spark)
    wait = f"{WAITS} days"
    closed = windows.closed_windows(stream, "ts", "1 day", wait, ["event_type"], F.count("*").alias("on_time"))
    closed = windows.appended(closed, f"{folder}/closed", f"{folder}/closed-checkpoint").select("window_start", "event_type", "on_time")
    late = windows.late_rows(stream, f"{folder}/aside", f"{folder}/aside-checkpoint", "ts", "1 day", wait)
    late = late.groupBy(F.window("ts", "1 day")["start"].alias("window_start"), "event_type").agg(F.count("*").alias("late"))
    both = closed.join(late, ["window_start", "event_type"], "full")
    return both.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", F.coalesce("on_time", F.lit(0)).alias("on_time"), F.coalesce("late", F.lit(0)).alias("late"))


@query("""WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), d AS (SELECT event_id AS done, user_id, ts AS done_at FROM events WHERE event_type = 'click'),
p AS (SELECT c.event_id, d.done FROM c JOIN d ON d.user_id = c.user_id AND d.done_at >= c.ts AND d.done_at <= c.ts + INTERVAL 12 HOUR)
SELECT * FROM p UNION ALL SELECT event_id, NULL FROM c WHERE event_id NOT IN (SELECT event_id FROM p) AND ts + INTERVAL 12 HOUR < least((SELECT max(ts) FROM c), (SELECT max(done_at) FROM d)) - INTERVAL 1 HOUR""")
def stream_downloads(spark, sf_dir):
    """Views as candidates, clicks of the same user within 12 hours as their finished downloads; candidates without any come once none
    can follow. Two files, before and after a day."""
    folder = work_folder(spark)
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "event_type", "ts")
    for part in (F.col("ts") < F.lit("2024-01-15").cast("timestamp"), F.col("ts") >= F.lit("2024-01-15").cast("timestamp")):
        e.filter(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = lambda kind: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").filter(F.col("event_type") == kind)
    then = stream("click").select("user_id", F.col("event_id").alias("done"), F.col("ts").alias("done_at"))
    found = windows.with_followers(stream("view").select("event_id", "user_id", "ts"), then, "user_id", "ts", "done_at", "12 hours", "1 hour")
    return windows.appended(found, f"{folder}/out", f"{folder}/checkpoint").select("event_id", "done")


# ---- search ----


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'll wid') OR contains(lower(p_type), 'll wid') OR contains(lower(p_brand), 'll wid')")
def search_indexed(spark, sf_dir):
    """Parts that hold some words, by postings of trigrams."""
    parts, columns, folder = table(spark, sf_dir, "part"), ["p_name", "p_type", "p_brand"], work_folder(spark)
    search.write_postings(parts, "p_partkey", columns, f"{folder}/postings")
    return search.found(parts, "p_partkey", columns, f"{folder}/postings", "LL Wid").select("p_partkey", "p_name", "p_type")


# ---- texts read wrongly ----


@query(r"SELECT doc_id, text AS strict, CASE WHEN regexp_matches(text, '[\x{80}-\x{FF}]') THEN text END AS lenient FROM documents WHERE text IS NOT NULL")
def mojibake_repaired(spark, sf_dir):
    """Documents whose UTF-8 was read as Latin-1, turned back: as a whole, and (where a letter of Latin-1 shows it) leniently."""
    wrong = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text", wrong.alias("wrong"))
    lenient = F.when(F.col("text").rlike("[\u0080-ÿ]"), text.repair_leniently(F.col("wrong")))
    return docs.select("doc_id", text.repair_mojibake(F.col("wrong")).alias("strict"), lenient.alias("lenient"))


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def report_read_back(spark, sf_dir):
    """A report (kinds of events and their counts, and the newest of two by time) written as one JSON object and read back."""
    folder = work_folder(spark)
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    whole = counts.agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("event_type").alias("kind"), "n")).alias("rows"))).alias("value"))
    for name, report in (("old", spark.createDataFrame([('{"rows": []}',)], "value string")), ("new", whole)):
        report.coalesce(1).write.text(f"{folder}/{name}")
    newest = files.latest_file(spark, f"{folder}/*/part-*").first()["path"]
    return files.read_report(spark, newest).select(F.inline("rows")).select("kind", "n")

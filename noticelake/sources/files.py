"""File sources: CSV, zipped CSV, JSON reports, logs, and text out of office and archive files by the standard library."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from html.entities import html5
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.folders import work_folder
from ..functions.text import trimmed
from ..operators.documents import normalize_extracted, strip_page_lines
from .blocks import numbered_lines, physical_lines, read_records, tail_lines
from .pdf import page_texts


@dataclass
class Limits:
    """How much of a file is read, None for all of it. Texts that a limit has cut are flagged as truncated."""

    max_bytes: int | None = 50_000_000
    max_members: int | None = 10
    max_tables: int | None = 50
    max_sheets: int | None = 20
    max_rows: int | None = 2000
    max_columns: int | None = 50
    max_chars: int | None = 400_000


#: Nothing is cut.
WHOLE = Limits(*[None] * 7)


class Reading:
    """What a file is read with: its limits, whether one has cut something, and members without a reader."""

    def __init__(self, limits: Limits):
        self.limits, self.truncated, self.skipped = limits, False, 0

    def first(self, values: list, most: int | None) -> list:
        if most is not None and len(values) > most:
            self.truncated = True
            return values[:most]
        return values

    def text(self, parts: list[str], by: str = "\n") -> str:
        whole, most = by.join(parts), self.limits.max_chars
        if most is not None and len(whole) > most:
            self.truncated = True
            return whole[:most]
        return whole


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Header names decide; all strings; cells may hold line feeds and doubled quotes; bad bytes are replaced. A file is read by block."""
    found = read_records(spark, path)
    return found.select(*[(F.col(f"`{c}`") if c in found.columns else F.lit(None).cast("string")).alias(c) for c in columns])


def read_zipped_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The first .csv member of each archive, by row."""
    return zipped_rows(spark.read.format("binaryFile").load(path), columns)


def zipped_rows(files: DataFrame, columns: list[str]) -> DataFrame:
    """As read_zipped_csv, of archives in a column `content`. They are read in tasks; a row is yielded as it is parsed."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    member = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
                    if member is None:
                        continue
                    rows = csv.DictReader(io.TextIOWrapper(z.open(member), "utf-8-sig", errors="replace", newline=""))
                    held = []
                    for r in rows:
                        held.append([r.get(c) for c in columns])
                        if len(held) == 5000:
                            yield pd.DataFrame(held, columns=columns)
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=columns)

    return files.select("content").mapInPandas(run, schema)


def read_export(spark: SparkSession, path: str, dates: list[str], score: str = "score") -> DataFrame:
    """A CSV export as strings, empty for null, with <date>_dt and score_num beside; what cannot be read is null."""
    raw = read_records(spark, path)
    out = raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns])
    out = out.withColumns({f"{d}_dt": F.try_to_timestamp(F.col(d)) for d in dates if d in out.columns})
    return out.withColumn("score_num", F.col(score).try_cast("double")) if score in out.columns else out


def latest_file(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").load(pattern).select("path", "modificationTime").orderBy(F.col("modificationTime").desc(), F.col("path").desc()).limit(1)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


LEVEL = r"\b(DEBUG|INFO|WARNING|ERROR|CRITICAL)\b"


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, level, line) of log files, numbered from 1 in each file; a file is read by block."""
    return numbered_lines(spark, path).select("file", "line_no", F.regexp_extract("line", LEVEL, 1).alias("level"), F.regexp_replace("line", "\r$", "").alias("line"))


def log_tail(spark: SparkSession, path: str, level: str | None = None, most: int = 200) -> DataFrame:
    """(at, level, line): the last lines of a file (of several the last by name), of one level if given, with the bytes before them.
    Only the blocks at the end are read that hold them."""
    newest = spark.read.format("binaryFile").load(path).select("path").orderBy(F.col("path").desc()).first()
    of_level = lambda line: (m := re.search(LEVEL, line)) is not None and m[1] == level
    found = tail_lines(spark, newest["path"], most, of_level if level else None) if newest else []
    lines = spark.createDataFrame(found, "at bigint, line string")
    return lines.select("at", F.regexp_extract("line", LEVEL, 1).alias("level"), "line")


def count_errors(spark: SparkSession, path: str) -> DataFrame:
    """(file, errors) of each log file."""
    lines = physical_lines(spark, path).withColumn("level", F.regexp_extract("line", LEVEL, 1))
    return lines.groupBy("file").agg(F.count_if(F.col("level") == "ERROR").alias("errors"))


CATALOG = "success boolean, result struct<resources:array<struct<id:string,name:string,format:string,url:string,last_modified:string>>>"


def catalog_resources(spark: SparkSession, path: str) -> DataFrame:
    """(position, id, name, format, url, last_modified) of a dataset's resources, from the catalogue's reply as it landed in a file; a
    reply that tells of no success has none. (The request itself, with its retries, is the caller's: tasks have no network here.)"""
    reply = spark.read.option("multiLine", True).schema(CATALOG).json(path).filter("success")
    return reply.select(F.posexplode("result.resources").alias("position", "r")).select("position", "r.*")


def resource_choice(resources: DataFrame, preferred: str = "open") -> DataFrame:
    """The best CSV or ZIP resource about tenders: by preference, wording and language; the first where equal."""
    name = F.lower(F.col("name"))
    has = lambda w: F.contains(name, F.lit(w))
    second = {"open": "new", "new": "open"}.get(preferred)
    score = F.when(has("tender") & has("notice"), 10).otherwise(0) + F.when(has(preferred), 100).otherwise(0) + (F.when(has(second), 50).otherwise(0) if second else F.lit(0))
    score = score + F.when(has("en"), 5).otherwise(0) + F.when(has("french") | has("fr"), 5).otherwise(0)
    fits = F.upper("format").isin("CSV", "ZIP") & has("tender")
    return resources.filter(fits).withColumn("score", score).orderBy(F.col("score").desc(), "position").limit(1)


#: Tried in turn; the last fits any bytes.
ENCODINGS = ("utf-8", "utf-16", "latin-1")


def decodable(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def decode_text(data: bytes, reading: Reading) -> str:
    return reading.text([data.decode(next(e for e in ENCODINGS if decodable(data, e)))])


def docx_text(data: bytes, reading: Reading) -> str:
    """Paragraphs, then tables as CSV blocks."""
    space, limits = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", reading.limits
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{space}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{space}t"))
    out = [text(p) for p in body.findall(f"{space}p") if text(p).strip()]
    for k, table in enumerate(reading.first(body.findall(f"{space}tbl"), limits.max_tables), 1):
        out.append(f"TABLE {k}")
        out += [csv_line(reading.first([text(c) for c in row.findall(f"{space}tc")], limits.max_columns)) for row in reading.first(table.findall(f"{space}tr"), limits.max_rows)]
    return reading.text(out)


def csv_line(cells: list[str]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(cells)
    return out.getvalue()


MAIN, REL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Numbers of built-in formats that show days or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def date_styles(z: zipfile.ZipFile) -> set[int]:
    """Which styles of a workbook show dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{MAIN}numFmt") if re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode") or ""), re.I)}
    return {k for k, x in enumerate(root.findall(f"{MAIN}cellXfs/{MAIN}xf")) if int(x.get("numFmtId") or 0) in DATE_FORMATS | own}


def cell_text(c, strings: list[str], dates: set[int]) -> str:
    value = c.find(f"{MAIN}v")
    if c.get("t") == "s" and value is not None:
        return strings[int(value.text)]
    if value is not None and value.text and c.get("t") in (None, "n") and int(c.get("s") or 0) in dates:
        at = datetime(1899, 12, 30) + timedelta(days=float(value.text))
        return at.strftime("%Y-%m-%d" if at.time() == at.min.time() else "%Y-%m-%d %H:%M:%S")
    return "".join(t.text or "" for t in c.iter(f"{MAIN}t")) or (value.text if value is not None else "") or ""


def xlsx_sheets(data: bytes, reading: Reading) -> list[tuple[str, list[list[str]]]]:
    """(name, rows of cells) of each sheet; days and times as they are shown, not as numbers."""
    limits, out = reading.limits, []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names, dates = set(z.namelist()), date_styles(z)
        strings = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in reading.first(list(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")), limits.max_sheets):
            target = targets[sheet.get(f"{REL}id")].lstrip("/")
            root, rows = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")), []
            for row in reading.first(list(root.iter(f"{MAIN}row")), limits.max_rows):
                cells: dict[int, str] = {}
                for c in row.findall(f"{MAIN}c"):
                    at = 0
                    for letter in re.match("[A-Z]*", c.get("r") or "")[0]:
                        at = at * 26 + ord(letter) - 64
                    cells[at or len(cells) + 1] = cell_text(c, strings, dates)
                rows.append(reading.first([cells.get(i, "") for i in range(1, max(cells, default=0) + 1)], limits.max_columns))
            out.append((sheet.get("name"), rows))
    return out


def xlsx_text(data: bytes, reading: Reading) -> str:
    """Each sheet as a CSV block under its name."""
    out: list[str] = []
    for name, rows in xlsx_sheets(data, reading):
        out += [f"SHEET: {name}", *map(csv_line, rows)]
    return reading.text(out)


def sheet_hints(text: str, most: int = 5) -> list[str]:
    """Names of the first sheets of a workbook's text, for prompts and memos."""
    return [f"Sheet: {line[7:]}" for line in text.split("\n") if line.startswith("SHEET: ")][:most]


def zip_text(data: bytes, reading: Reading) -> str:
    """Supported members under their names; others, archives within it too, are counted as skipped."""
    out, total, limits = [], 0, reading.limits
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        members = [i for i in z.infolist() if not i.is_dir()]
        supported = [i for i in members if suffix(i.filename) in READERS and suffix(i.filename) != "zip"]
        reading.skipped += len(members) - len(supported)
        for info in reading.first(supported, limits.max_members):
            total += info.file_size
            if limits.max_bytes is not None and total > limits.max_bytes:
                reading.truncated = True
                break
            out += [f"FILE: {info.filename}", READERS[suffix(info.filename)](z.read(info), reading)]
    return reading.text(out)


#: Stands between the pages of a text.
PAGE_END = "\f"


def pdf_text(data: bytes, reading: Reading) -> str:
    """Text of a PDF, pages apart by form feeds: by pypdf if it is installed, else by `pdf`."""
    try:
        from pypdf import PdfReader
    except ImportError:
        pages = page_texts(data)
    else:
        pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]
    return reading.text([p.replace(PAGE_END, "\n") for p in pages], PAGE_END)


READERS = {"txt": decode_text, "csv": decode_text, "docx": docx_text, "xlsx": xlsx_text, "zip": zip_text, "pdf": pdf_text}


def suffix(name: str) -> str:
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def extract(content: bytes | None, name: str, limits: Limits | None = None) -> tuple[str, str | None, bool]:
    """Text and error of a file, and whether a limit has cut it; a bad file is no failure of the job."""
    return read_file(content, name, limits)[:3]


def read_file(content: bytes | None, name: str, limits: Limits | None = None) -> tuple[str, str | None, bool, int]:
    """As extract, and how many members of an archive have no reader."""
    reading = Reading(limits or Limits())
    reader, most = READERS.get(suffix(name)), reading.limits.max_bytes
    if reader is None:
        return "", "unsupported", False, 0
    if content is None:
        return "", "no content", False, 0
    if most is not None and len(content) > most:
        return "", "too large", False, 0
    try:
        return reader(content, reading), None, reading.truncated, reading.skipped
    except Exception as error:  # a damaged file says so in its row
        return "", f"{type(error).__name__}: {error}", False, 0


EXTRACTED = "path string, text string, error string, needs_ocr boolean, truncated boolean, skipped int"


def extract_files(files: DataFrame, least_pdf_chars: int = 50, limits: Limits | None = None) -> DataFrame:
    """(path, text, error, needs_ocr, truncated, skipped) from binary files; the type goes by suffix. One file is in memory at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                text, error, cut, skipped = read_file(content, path, limits)
                yield pd.DataFrame([[path, text, error, suffix(path) == "pdf" and len(text) < least_pdf_chars, cut, skipped]], columns=[c.split()[0] for c in EXTRACTED.split(", ")])

    return files.select("path", "content").mapInPandas(run, EXTRACTED)


def joined_pages(texts: DataFrame) -> DataFrame:
    """(path, text): texts whose pages are apart by form feeds, without the lines that their pages share, pages apart by blank lines."""
    pages = texts.select("path", F.posexplode(F.split("text", PAGE_END)).alias("at", "text")).withColumn("page", F.concat_ws("#", "path", "at"))
    clean = strip_page_lines(pages, "path", "page").join(pages.select("page", "at"), "page")
    kept = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("at", "text"))))
    return clean.groupBy("path").agg(trimmed(F.array_join(F.transform(kept, lambda x: x["text"]), "\n\n")).alias("text"))


def extracted_texts(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """As extract_files, with the texts normalised: lines that a text's pages share out, lines trimmed, repeated ones out, wrongly read
    characters repaired. The extracted texts are written first, so each file is read and parsed once."""
    spark, schema = files.sparkSession, EXTRACTED
    folder = work_folder(spark)
    extract_files(files, limits=limits).write.parquet(f"{folder}/texts")
    found = spark.read.schema(schema).parquet(f"{folder}/texts")
    paged = F.lower("path").endswith(".pdf")
    texts = found.filter(~paged).select("path", "text").unionByName(joined_pages(found.filter(paged)))
    return found.drop("text").join(normalize_extracted(texts, "path"), "path")


REFERENCE = "&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"


def reference_values() -> dict[str, str]:
    """What each named reference stands for (a no-break space as a plain one), and the numbers that browsers read as Windows-1252."""
    named = {f"&{name}": " " if value == "\u00a0" else value for name, value in html5.items() if name.endswith(";")}
    narrow = {str(n): bytes([n]).decode("cp1252", "replace") for n in range(0x80, 0xA0)}
    return named | {n: c for n, c in narrow.items() if c != "\ufffd"}


def decoded_entities(text: Column) -> Column:
    """Character references decoded, each once, so `&amp;lt;` gives `&lt;`. Numbers that are no character give U+FFFD, unknown names
    stay. The text is cut at its references and joined again: linear in its length."""
    known = F.create_map(*[F.lit(x) for p in reference_values().items() for x in p])

    def numbered(e: Column) -> Column:
        number = F.when(e.rlike("^&#[xX]"), F.conv(F.regexp_extract(e, "([0-9A-Fa-f]+);", 1), 16, 10)).otherwise(F.regexp_extract(e, "([0-9]+);", 1)).cast("long")
        none = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(~none, number)), 8, "0")), "UTF-32")
        return F.when(none, "\ufffd").when(number == 0xA0, " ").otherwise(F.coalesce(F.when(number.between(0x80, 0x9F), F.element_at(known, number.cast("string"))), char))

    value = lambda e: F.when(e.startswith("&#"), numbered(e)).otherwise(F.coalesce(F.element_at(known, e), e))
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({REFERENCE})"), F.lit(1)), value)
    whole = F.array_join(F.zip_with(F.split(text, REFERENCE, -1), found, lambda x, v: F.concat(x, F.coalesce(v, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def html_text(df: DataFrame, html: str = "html") -> DataFrame:
    """df with title and text of a page: scripts, styles, comments and tags out, common entities decoded. In the JVM."""
    body = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(body, r"(?is)</?(?:p|br|div|li|h[1-6]|tr|article|nav|section)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", "")
    text = decoded_entities(text)
    text = F.trim(F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), r"\s*\n\s*", "\n"))
    return df.withColumns({"title": F.trim(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)), "text": F.regexp_replace(text, r"^\n+|\n+$", "")})

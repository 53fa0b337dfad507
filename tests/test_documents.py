import io
import zipfile

from pyspark.sql import functions as F

from noticelake.operators import documents, requirements
from noticelake.sources import files
from noticelake.streaming import state as streaming
from noticelake.streaming.buckets import BucketedTable


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_repeated_lines_go(spark):
    text = "\n".join([f"line number {k}" for k in range(25)] + ["CONFIDENTIAL FOOTER"] * 3)
    got = documents.normalize_extracted(docs(spark, text, None, "one\n\n two "), "doc_id").orderBy("doc_id").collect()
    assert "CONFIDENTIAL" not in got[0]["text"] and len(got[0]["text"].split("\n")) == 25
    assert got[1]["text"] == "" and got[2]["text"] == "one\ntwo"


def test_sections(spark):
    got = documents.sectionize(docs(spark, "intro\n1. Mandatory requirements\nmust a\nmust b\nEVALUATION CRITERIA\nprice", "Exigences obligatoires:\nx", "plain\ntext"), "doc_id").orderBy("doc_id", "section").collect()
    assert [(r["doc_id"], r["heading"], r["n_lines"]) for r in got] == [(0, "1. Mandatory requirements", 2), (0, "EVALUATION CRITERIA", 1), (1, "Exigences obligatoires:", 1)]


def test_chunks_cover_the_text(spark):
    text = " ".join(f"word{k}" for k in range(500))
    got = documents.chunks(docs(spark, text), "doc_id", most=300, overlap=40).orderBy("chunk").collect()
    assert got[0]["start"] == 0 and got[-1]["stop"] == len(text) and all(b["start"] < a["stop"] for a, b in zip(got, got[1:]))
    assert all(r["text"] == text[r["start"] : r["stop"]].strip() for r in got)
    assert documents.chunk(" " * 30 + "x", 10, 2)[0][1] == 31 and documents.chunk("", 5, 1) == []
    assert documents.chunk("x" * 10, 3, 5)[-1][1] == 10  # an overlap longer than a chunk still moves on


def test_evidence_and_dedupe(spark):
    d = spark.createDataFrame([("Provide hosting services", "we need hosting and services", ["A b c!", "a  B c", "", "d e f"])], "item string, e string, xs array<string>")
    got = d.select(requirements.has_evidence(F.col("item"), F.col("e")).alias("a"), requirements.has_evidence(F.lit("by 2026-01-30"), F.lit("due 2026-01-30")).alias("b"), requirements.has_evidence(F.col("item"), F.lit("other")).alias("c"), requirements.ordered_distinct(F.col("xs")).alias("d")).first()
    assert (got["a"], got["b"], got["c"], got["d"]) == (True, True, False, ["A b c!", "d e f"])


def test_summary_is_cleaned(spark):
    d = spark.createDataFrame([(["Table of contents", "Provide hosting services", "provide hosting services"], ["Closing 2026-01-30", "soon"], ["none"], ["a.pdf", "a.pdf"], "Provide hosting services by 2026-01-30")], "requirements array<string>, dates array<string>, key_risks array<string>, attachments_used array<string>, evidence string")
    got = requirements.clean_summary(d).first()
    assert (got["requirements"], got["dates"], got["key_risks"], got["attachments_used"]) == (["Provide hosting services"], ["Closing 2026-01-30"], [], ["a.pdf"])


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


def test_office_and_zip_text(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
    docx = zipped(word__document_dot_xml=f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr>{cell.format("a")}{cell.format("b,c")}</w:tr></w:tbl></w:body></w:document>')
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    xlsx = zipped(
        xl__workbook_dot_xml=f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>',
        xl___rels__workbook_dot_xml_dot_rels='<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        xl__worksheets__sheet1_dot_xml=f'<worksheet xmlns="{m}"><sheetData><row><c r="A1" t="inlineStr"><is><t>k</t></is></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>',
    )
    styles = f'<styleSheet xmlns="{m}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    dated = zipped(
        xl__workbook_dot_xml=f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="A" sheetId="1" r:id="r1"/><sheet name="B" sheetId="2" r:id="r1"/></sheets></workbook>', xl___rels__workbook_dot_xml_dot_rels='<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        xl__worksheets__s_dot_xml=f'<worksheet xmlns="{m}"><sheetData><row><c r="A1" s="1"><v>46052</v></c></row><row><c r="A2"><v>5</v></c></row></sheetData></worksheet>', xl__styles_dot_xml=styles,
    )
    text, error, cut = files.extract(dated, "x.xlsx")
    assert (text, error, cut) == ("SHEET: A\n2026-01-30\n5\nSHEET: B\n2026-01-30\n5", None, False) and files.sheet_hints(text) == ["Sheet: A", "Sheet: B"]
    assert files.extract(dated, "x.xlsx", files.Limits(max_sheets=1, max_rows=1)) == ("SHEET: A\n2026-01-30", None, True)
    assert files.extract(b"x" * 500_000, "t.txt") == ("x" * 400_000, None, True) and files.extract(b"x" * 500_000, "t.txt", files.WHOLE) == ("x" * 500_000, None, False)
    pages = spark.createDataFrame([("a.pdf", "Head\na\n\f Head\nb"), ("b.pdf", " one\n"), ("c.pdf", "")], "path string, text string")
    assert {r["path"]: r["text"] for r in files.joined_pages(pages).collect()} == {"a.pdf": "a\n\nb", "b.pdf": "one", "c.pdf": ""}
    (tmp_path / "a.docx").write_bytes(docx)
    (tmp_path / "b.xlsx").write_bytes(xlsx)
    (tmp_path / "c.zip").write_bytes(zipped(n_dot_txt="inner", x_dot_exe="no"))
    (tmp_path / "d.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = {r["path"][-6:]: r for r in files.extract_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got["a.docx"]["text"] == 'Hello\nTABLE 1\na,"b,c"' and got["b.xlsx"]["text"] == "SHEET: S\nk,,3"
    assert got["/c.zip"]["text"] == "FILE: n.txt\ninner" and got["/d.txt"]["text"] == "é" and got["e.docx"]["error"].startswith("BadZipFile")


def test_character_references(spark):
    d = spark.createDataFrame([("<p>a &lt;b&gt; &eacute;&#233;&#x1F600; &amp;lt; &unknown; &nbsp;x</p>",)], "html string")
    assert files.html_text(d).first()["text"] == "a <b> éé\U0001f600 &lt; &unknown; x"


def test_csv_sources(spark, tmp_path):
    body = '﻿a,b\n1,"x ""y"", z\nsecond"\n'
    (tmp_path / "x.csv").write_text(body)
    (tmp_path / "x.zip").write_bytes(zipped(t_dot_csv=body))
    for got in (files.read_csv(spark, str(tmp_path / "x.csv"), ["a", "b", "c"]), files.read_zipped_csv(spark, str(tmp_path / "x.zip"), ["a", "b", "c"])):
        assert [tuple(r) for r in got.collect()] == [("1", 'x "y", z\nsecond', None)]


def test_exports_reports_and_logs(spark, tmp_path):
    (tmp_path / "e.csv").write_text('uid,score,close\na,1.5,2026-01-30\nb,x,\n')
    got = files.read_export(spark, str(tmp_path / "e.csv"), ["close"]).orderBy("uid").collect()
    assert [(r["score"], r["score_num"], r["close"], str(r["close_dt"])) for r in got] == [("1.5", 1.5, "2026-01-30", "2026-01-30 00:00:00"), ("x", None, "", "None")]
    assert files.latest_file(spark, str(tmp_path / "*.csv")).first()["path"].endswith("e.csv")
    (tmp_path / "r.json").write_text('{\n "totals": {"kept": 2},\n "reasons": {"a": 1}\n}')
    assert files.read_report(spark, str(tmp_path / "r.json")).first()["totals"]["kept"] == 2
    (tmp_path / "x.log").write_text("".join(f"2026 | {'ERROR' if k % 5 == 0 else 'INFO'} | line {k}\n" for k in range(1, 21)))
    assert [r["line"][-2:] for r in files.log_tail(spark, str(tmp_path / "x.log"), most=3).collect()] == ["18", "19", "20"]
    assert [(r["line"][-2:], r["level"]) for r in files.log_tail(spark, str(tmp_path / "x.log"), "ERROR", 2).collect()] == [("15", "ERROR"), ("20", "ERROR")]
    assert sorted((r["line_no"], r["line"][-2:].strip()) for r in files.log_lines(spark, str(tmp_path / "x.log")).collect()) == [(k, str(k)) for k in range(1, 21)]
    assert files.count_errors(spark, str(tmp_path / "x.log")).first()["errors"] == 4


def test_catalogue_and_mail(spark, tmp_path):
    from noticelake.operators import summaries

    (tmp_path / "c.json").write_text('{"success": true, "result": {"resources": [{"name": "Open tender notice", "format": "CSV", "url": "u"}, {"name": "x", "format": "PDF"}]}}')
    (tmp_path / "d.json").write_text('{"success": false}')
    rows = files.catalog_resources(spark, str(tmp_path / "c.json"))
    assert [(r["position"], r["format"]) for r in rows.collect()] == [(0, "CSV"), (1, "PDF")] and files.resource_choice(rows).first()["url"] == "u"
    assert files.catalog_resources(spark, str(tmp_path / "d.json")).count() == 0
    d = spark.createDataFrame([("new", 1, "<tr><td>a</td></tr>"), ("watch", 1, "<tr><td>w</td></tr>"), ("new", 2, "<tr><td>b</td></tr>")], "section string, place int, html string")
    page = summaries.digest_html(d, "2026-01-30", 2, 5, {"with_requirements": 1, "total": 4, "percent": 25}, "x<y.csv")
    assert page.index("<td>a</td>") < page.index("<td>b</td>") < page.index("<td>w</td>") and "<b>25%</b> (1 of 4)" in page and "x&lt;y.csv" in page and "Upcoming" not in page
    mail = summaries.digest_message("a@x.org", ["b@x.org", "c@x.org"], "Digest", page, ("f.csv", "k\n1\n"))
    assert mail["To"] == "b@x.org, c@x.org" and [p.get_content_type() for p in mail.walk()][-1] == "text/csv"


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    """The second batch fails after its state is written, so it runs again when the stream restarts."""
    schema, source, fails = "key long, close_date string, amendment int, attachment_hash string", tmp_path / "in", [True]

    class Fragile(streaming.SnapshotTable):
        def write(self, df, batch):
            super().write(df, batch)
            if batch == 1 and fails.pop():
                fails.append(False)
                raise RuntimeError("lost")

    table = Fragile(spark, f"file://{tmp_path}/state")

    def run():
        stream = spark.readStream.schema(schema).parquet(str(source))
        return streaming.diff_stream(stream, table, "key", [F.col("amendment").desc()], f"{tmp_path}/checkpoint", f"file://{tmp_path}/events", greatest=["amendment"])

    spark.createDataFrame([(1, "a", 1, "h"), (2, "a", 1, "h")], schema).write.parquet(str(source))
    run()
    spark.createDataFrame([(1, "b", 0, "h"), (2, "a", 1, "h"), (3, "a", 1, "h")], schema).write.mode("append").parquet(str(source))
    try:
        run()
        raise AssertionError("the second batch did not fail")
    except Exception as error:
        assert "lost" in str(error)
    got = sorted((r["batch"], r["key"], ",".join(r["events"])) for r in run().collect())
    assert got == [(0, 1, "new"), (0, 2, "new"), (1, 1, "close_date_changed"), (1, 3, "new")]
    assert {r["key"]: (r["close_date"], r["amendment"]) for r in table.current().collect()} == {1: ("b", 1), 2: ("a", 1), 3: ("a", 1)}


def test_stream_upsert_keeps_the_largest_amendment(spark, tmp_path):
    source, schema = tmp_path / "in", "key long, seen_at timestamp, amendment int"
    table = BucketedTable(spark, f"file://{tmp_path}/state", "key", 4)

    def batch(rows):
        spark.createDataFrame(rows, "key long, seen_at string, amendment int").selectExpr("key", "cast(seen_at as timestamp) seen_at", "amendment").write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        return streaming.upsert_stream(stream, table, [F.col("seen_at").desc(), F.col("amendment").desc()], f"{tmp_path}/checkpoint", greatest=["amendment"])

    batch([(1, "2026-01-01", 2), (1, "2026-01-02", 3), (2, "2026-01-01", 0)])
    got = {r["key"]: r["amendment"] for r in batch([(1, "2026-01-03", 1), (3, "2026-01-03", 5)]).collect()}
    assert got == {1: 3, 2: 0, 3: 5}


def test_stream_windows_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.select("event_id", "ts", "user_id", "event_type", "value").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "e")).schema).parquet(str(tmp_path / "e"))
    whole = streaming.tumbling_counts(events)
    got = streaming.run_to_table(streaming.tumbling_counts(stream), str(tmp_path / "o"), whole)
    assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in whole.collect()} and got.count() > 0


def test_low_signal_and_routes(spark):
    d = spark.createDataFrame([(x,) for x in ("SOC 2", "TLS", "AB/12", "hosting", "Provide hosting services", "ACME CORP INC", "Scope of the work to do", "Level 3 analyst", "Submit via the portal", "Encrypted backup of data")], "x string")
    got = d.select(requirements.low_signal_requirement(F.col("x")).alias("low"), requirements.is_boilerplate(F.col("x")).alias("b"), requirements.route(F.col("x")).alias("r")).collect()
    assert [r["low"] for r in got] == [False, False, False, True, False, True, False, False, False, False]
    assert got[6]["b"] and not got[4]["b"]
    assert [r["r"] for r in got[7:]] == ["staffing", "submission", "technical"]

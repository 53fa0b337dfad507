"""State tables by bucket, keyed state, windows that close, files by block, the catalogue as a source, daily parts, search."""

import json
import os
import random
import threading
from datetime import date, datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from noticelake.operators import daily, lookups, reports, search, state
from noticelake.plans import catalog
from noticelake.sources import blocks, catalogue, files
from noticelake.streaming import keyed
from noticelake.streaming.buckets import BucketedTable

# ---- state tables


def rows(spark, *values):
    return spark.createDataFrame(list(values), "key long, seen string, amendment int")


def parts(folder):
    return {(d, f) for d in os.listdir(folder) if d.startswith("bucket=") for f in os.listdir(f"{folder}/{d}") if f.startswith("part-")}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t", "key", 32)
    table.merge(rows(spark, *[(k, "a", 1) for k in range(200)]), 0, greatest=["amendment"])
    before = parts(tmp_path / "t/rows")
    table.merge(rows(spark, (3, "b", 0), (1000, "b", 5)), 1, greatest=["amendment"])
    after, own = parts(tmp_path / "t/rows"), {r["bucket"] for r in table.bucketed(rows(spark, (3, "", 0), (1000, "", 0))).collect()}
    assert {x for x in before if x[0] not in {f"bucket={b}" for b in own}} <= after and len(before - after) <= len(own)
    got = {r["key"]: (r["seen"], r["amendment"]) for r in table.read().collect()}
    assert len(got) == 201 and got[3] == ("b", 1) and got[1000] == ("b", 5) and got[4] == ("a", 1)


@pytest.mark.parametrize("step", ["_stage", "_overwrite"])
@pytest.mark.parametrize("done", [False, True])
def test_a_batch_that_breaks_off_runs_again(spark, tmp_path, step, done):
    """It breaks off before or after a step; counting shows a row that a batch has changed twice."""

    class Fragile(BucketedTable):
        fails = 0

    def fragile(self, *args):
        if done:
            getattr(BucketedTable, step)(self, *args)
        if self.fails:
            self.fails -= 1
            raise RuntimeError("lost")
        if not done:
            getattr(BucketedTable, step)(self, *args)

    setattr(Fragile, step, fragile)
    table = Fragile(spark, f"file://{tmp_path}/t", "key", 4)
    table.merge(rows(spark, *[(k, "a", 1) for k in range(40)]), 0)
    counted = lambda old, new: state.upsert(old, new.withColumn("amendment", F.lit(1)), "key").withColumn("amendment", F.col("amendment") + 1)
    table.fails = 1
    with pytest.raises(RuntimeError):
        table.apply(rows(spark, (1, "b", 0)), 1, counted)
    for _ in range(2):
        table.apply(rows(spark, (1, "b", 0)), 1, counted)
    own = table.bucketed(rows(spark, (1, "", 0))).first()["bucket"]
    got = {r["key"]: (r["bucket"], r["amendment"]) for r in table.bucketed(table.read()).collect()}
    assert len(got) == 40 and all(n == (2 if b == own else 1) for b, n in got.values())


def test_a_bucket_that_loses_its_last_row(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t", "uid", 4)
    edits = spark.createDataFrame([(1, "seen", " note ")], "uid long, status string, note string")
    table.apply(edits, 0, state.put_marks)
    assert [tuple(r) for r in table.read().collect()] == [(1, "seen", "note")]
    table.apply(edits, 1, lambda old, new: state.remove_key(old, new, "uid"))
    assert table.read().count() == 0 and table.read().columns == ["uid", "status", "note"]
    table.apply(edits, 2, state.put_marks)
    assert table.read().count() == 1
    table.apply(edits.limit(0), 3, state.put_marks)
    assert table.read().count() == 1


# ---- keyed state


def notice_stream(spark, folder):
    schema = "key long, amendment int, close_date timestamp, attachment_hash string, seen_at timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def put(spark, folder, *values):
    at = lambda d: None if d is None else datetime(2026, 1, 1) + timedelta(days=d)
    frame = spark.createDataFrame([(k, a, at(c), h, at(s)) for k, a, c, h, s in values], "key long, amendment int, close_date timestamp, attachment_hash string, seen_at timestamp")
    frame.coalesce(1).write.mode("append").parquet(str(folder))


def test_keyed_state_goes_on_from_its_checkpoint(spark, tmp_path):
    def run(grace=None):
        return keyed.run_keyed(keyed.keyed_changes(notice_stream(spark, tmp_path / "in"), "0 seconds", grace), f"file://{tmp_path}/events", f"{tmp_path}/checkpoint")

    put(spark, tmp_path / "in", (1, 1, 10, "h", 0), (1, 2, 9, "h", 0), (2, None, 5, None, 1), (3, 0, None, "", 1))
    told = lambda df: sorted((r["batch"], r["key"], ",".join(r["events"]), r["amendment"]) for r in df.collect())
    assert told(run()) == [(0, 1, "new", 1), (0, 2, "new", None), (0, 3, "new", 0)]
    put(spark, tmp_path / "in", (1, 0, 11, "", 2), (2, 4, 5, "x", 2), (4, 1, 1, "h", 2))
    assert told(run())[3:] == [(1, 1, "close_date_changed", 1), (1, 2, "amendment,new_attachment", 4), (1, 4, "new", 1)]
    last = {r["key"]: r for r in run().filter("batch = 1").collect()}
    assert last[1]["first_seen"] < last[1]["last_seen"] and last[1]["attachment_hash"] == ""


def test_closed_notices_leave_and_come_back_as_new(spark, tmp_path):
    source = tmp_path / "in"
    put(spark, source, (1, 1, 2, "h", 0), (2, 1, 30, "h", 0))
    put(spark, source, (3, 1, 40, "h", 12))  # now the watermark is day 12, so key 1 (day 2 and a week) has closed
    put(spark, source, (2, 2, 30, "h", 13))
    put(spark, source, (1, 1, 50, "h", 14))
    found = keyed.run_keyed(keyed.keyed_changes(notice_stream(spark, source), "0 seconds", timedelta(days=7)), f"file://{tmp_path}/events", f"{tmp_path}/checkpoint")
    got = sorted((r["key"], r["batch"], ",".join(r["events"])) for r in found.collect())
    assert got == [(1, 0, "new"), (1, 2, "closed"), (1, 3, "new"), (2, 0, "new"), (2, 2, "amendment"), (3, 1, "new")]


# ---- files by block


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_by_block_equals_the_whole_reader(spark, tmp_path, small_blocks):
    rng = random.Random(8)
    cell = lambda: "".join(rng.choice(["a", "é", ",", '"', "\n", "\n\n", "x y", "1", "", ' "q" ', ",\n", "\r\n"]) for _ in range(rng.randrange(0, 8)))
    quoted = lambda x: '"' + x.replace('"', '""') + '"' if set(x) & set(',"\n\r') or rng.random() < 0.2 else x
    for name, n in (("a", 700), ("b", 3)):
        lines = ["id,one,two"] + [",".join([str(k), quoted(cell()), quoted(cell())]) for k in range(n)]
        lines.insert(2, f'"long","{"line of a cell" * 3}\n' + "inner, line\n" * 900 + '",z')  # spans many blocks
        (tmp_path / f"{name}.csv").write_text("﻿" * (name == "b") + "\n".join(lines) + "\n" * (name == "a"), newline="")
    theirs = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "*.csv"))
    theirs = sorted(map(str, (tuple(r) for r in theirs.collect())))
    ours = files.read_csv(spark, str(tmp_path / "*.csv"), ["id", "one", "two", "three"])
    assert sorted(str(tuple(r)[:3]) for r in ours.collect()) == theirs and ours.filter("three IS NOT NULL").count() == 0
    assert blocks.physical_lines(spark, str(tmp_path / "a.csv")).rdd.getNumPartitions() > 5


@pytest.mark.parametrize("line, states", [("a,b", (False, True)), ('a,"b', (True, False)), ('"a ""x"" b', (True, False)), ('a"b,c', (False, False)), ('",x', (True, False)), ('"",""', (False, True)), ('","', (False, True)), ("", (False, True))])
def test_state_after_a_line(line, states):
    assert (blocks.inside_after(line, False), blocks.inside_after(line, True)) == states


def test_csv_of_other_shapes(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n")
    assert files.read_csv(spark, str(tmp_path / "e.csv"), ["b", "a"]).collect() == []
    (tmp_path / "f.csv").write_text('"a","b ""c"""\r\n1,"x\r\ny"\r\n\r\n2\r\n')
    got = files.read_csv(spark, str(tmp_path / "f.csv"), ["a", 'b "c"']).collect()
    assert [(r[0], (r[1] or "").replace("\r", "")) for r in got] == [("1", "x\ny"), ("2", "")]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "*.csv"), ["a"])


def test_lines_are_numbered_across_blocks(spark, tmp_path, small_blocks):
    for name, n in (("a", 2000), ("b", 10), ("c", 0)):
        (tmp_path / f"{name}.log").write_text("".join(f"{name} {k} {'x' * (k % 90)}\n" for k in range(1, n + 1)))
    got = files.log_lines(spark, str(tmp_path)).select(F.regexp_extract("file", "([a-c]).log", 1).alias("f"), "line_no", F.split("line", " ")[1].alias("k")).collect()
    assert sorted((r["f"], r["line_no"]) for r in got) == [("a", k) for k in range(1, 2001)] + [("b", k) for k in range(1, 11)]
    assert all(str(r["line_no"]) == r["k"] for r in got)


def bytes_read(spark):
    return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())


def test_a_tail_reads_the_last_blocks(spark, tmp_path):
    line = lambda k: f"2026-01-30 | {'ERROR' if k % 50 == 0 else 'INFO'} | line {k} {'é' * (k % 30)}"
    path = tmp_path / "big.log"
    path.write_text("\n".join(line(k) for k in range(60_000)))
    before = bytes_read(spark)
    found = blocks.tail_lines(spark, f"file://{path}", 20, block=4096)
    assert [x[1] for x in found] == [line(k) for k in range(59_980, 60_000)] and bytes_read(spark) - before < 3 * 4096 < os.path.getsize(path) / 100
    assert all(path.read_bytes()[at : at + len(x.encode())] == x.encode() for at, x in found)
    before = bytes_read(spark)
    errors = blocks.tail_lines(spark, f"file://{path}", 7, lambda x: "ERROR" in x, block=4096)
    assert [x[1] for x in errors] == [line(k) for k in range(59_650, 60_000, 50)] and bytes_read(spark) - before < os.path.getsize(path) / 20
    (tmp_path / "odd.log").write_text("a\n\n" + "long" * 5000 + "\nlast\n")
    assert [x[1] for x in blocks.tail_lines(spark, f"file://{tmp_path}/odd.log", 9, block=64)] == ["a", "", "long" * 5000, "last"]
    (tmp_path / "none.log").write_text("")
    assert blocks.tail_lines(spark, f"file://{tmp_path}/none.log", 9) == []


# ---- the catalogue


class Server(BaseHTTPRequestHandler):
    state: dict = {}

    def log_message(self, *args):
        pass

    def do_HEAD(self):
        self.do_GET()

    def do_GET(self):
        s = Server.state
        s["asked"].append((self.command, self.path, self.headers.get("If-None-Match")))
        if self.path.startswith("/api"):
            if s["failures"]:
                s["failures"] -= 1
                return self.send_error(503)
            body, etag = json.dumps({"success": s["success"], "result": {"resources": [{"id": n, "name": n, "format": f, "url": f"http://localhost:{s['port']}/{n}"} for n, f in s["listed"]]}}).encode(), None
        else:
            body, etag = s["files"][self.path[1:]]
            if self.headers.get("If-None-Match") == etag:
                self.send_response(304)
                return self.end_headers()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        if etag:
            self.send_header("ETag", etag)
        self.end_headers()
        if self.command == "GET":
            self.wfile.write(body)


@pytest.fixture
def server(spark):
    httpd = ThreadingHTTPServer(("localhost", 0), Server)
    Server.state = {"port": httpd.server_port, "asked": [], "failures": 0, "success": True, "listed": [("a", "CSV"), ("b", "zip"), ("c", "PDF")], "files": {"a": (b"x" * 25, '"1"'), "b": (b"", '"1"'), "c": (b"p", '"1"')}}
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    spark.dataSource.register(catalogue.CatalogueSource)
    yield Server.state
    httpd.shutdown()


def read(spark, server, **options):
    return spark.read.format("catalogue").options(url=f"http://localhost:{server['port']}/api", wait="0.01", partBytes="10", **options).load()


def test_the_catalogue_is_read_by_resource(spark, server):
    server["failures"] = 2
    landed = read(spark, server)
    got = landed.collect()
    assert sorted((r["id"], r["part"], len(r["content"]), r["status"]) for r in got) == [("a", 0, 10, 200), ("a", 1, 10, 200), ("a", 2, 5, 200), ("b", 0, 0, 200)]
    known = catalogue.landed_marks(spark.createDataFrame(got, landed.schema))
    server["files"]["b"] = (b"new", '"2"')
    again = sorted((r["id"], r["status"], r["content"] and bytes(r["content"])) for r in read(spark, server, known=known).collect())
    assert again == [("a", 304, None), ("b", 200, b"new")]
    server["success"] = False
    with pytest.raises(Exception, match="no success"):
        read(spark, server).collect()
    server["success"], server["failures"] = True, 9
    with pytest.raises(Exception, match="503"):
        read(spark, server, attempts="3").collect()
    assert server["failures"] == 6


def test_the_catalogue_as_a_stream_has_what_changed(spark, server, tmp_path):
    def run():
        stream = spark.readStream.format("catalogue").options(url=f"http://localhost:{server['port']}/api", wait="0.01").load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(once=True).start().awaitTermination()
        return sorted((r["id"], r["etag"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("a", '"1"'), ("b", '"1"')]
    server["files"]["a"] = (b"other", '"2"')
    server["listed"].append(("c", "CSV"))
    assert run() == [("a", '"1"'), ("a", '"2"'), ("b", '"1"'), ("c", '"1"')]


# ---- daily parts, search, lookups, plans


def test_windows_of_daily_parts_equal_scans(spark):
    rng = random.Random(9)
    data = [(date(2026, 1, 1) + timedelta(days=rng.randrange(0, 50)), rng.randrange(0, 9)) for _ in range(400)] + [(None, 5)]
    d = spark.createDataFrame(data, "day date, v int")
    made = daily.daily_parts(d, F.col("day"), {"n": F.count("*"), "v": F.sum("v")})
    as_of, spans = date(2026, 2, 10), {"week": (7, 0), "before": (14, 7), "all": (400, 0), "none": (500, 400)}
    got = daily.windows(made, F.lit(as_of), spans, ["n", "v"]).first()
    for w, (back, to) in spans.items():
        inside = [v for t, v in data if t and to <= (as_of - t).days < back]
        assert tuple(got[w]) == (len(inside), sum(inside))
    anew = spark.createDataFrame([(date(2026, 2, 10), 1, 100), (date(2026, 5, 1), 1, 1)], "day date, n long, v long")
    once, twice = daily.replaced(made, anew), daily.replaced(daily.replaced(made, anew), anew)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) and once.filter("day = '2026-02-10'").first()["v"] == 100
    empty = daily.windows(made.limit(0), F.lit(as_of), spans, ["n"]).first()
    assert all(empty[w]["n"] == 0 for w in spans)


def test_search_by_index_equals_the_scan(spark, tmp_path):
    rng = random.Random(10)
    text = lambda: rng.choice([None, "", "".join(rng.choice("abAB é%_\n") for _ in range(rng.randrange(0, 14)))])
    d = spark.createDataFrame([(k, text(), text()) for k in range(300)], "k long, one string, two string")
    search.write_postings(d, "k", ["one", "two"], f"file://{tmp_path}/p", files=4)
    for words in ["ab", "A", "abab", "é", "b a", "BA ", "%_", "\n", "zzz", "aabab", ""]:
        ours = {r["k"] for r in search.found(d, "k", ["one", "two"], f"file://{tmp_path}/p", words).collect()}
        assert ours == {r["k"] for r in reports.searched(d, words, ["one", "two"]).collect()}, words
    plan = search.candidates(spark, f"file://{tmp_path}/p", "abab")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram, [aba,bab])]" in plan


def test_a_key_with_several_values_gives_one_row(spark):
    items = spark.createDataFrame([(1, "a", "b")], "i long, x string, y string")
    cache = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "0")], "k string, v string")
    assert [r["v"] for r in lookups.first_key_lookup(items, cache, ["x", "y"], "k", "v").collect()] == ["1"]
    stored = spark.createDataFrame([(1, "old")], "key long, payload string")
    new = spark.createDataFrame([(1, "p"), (1, "q")], "key long, payload string")
    assert [tuple(r) for r in state.put_payload(stored, new, "key").collect()] == [(1, "q")]


DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


def plan_of(spark, name):
    return catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", ["capped_notes", "chunk_quota", "retrieval_topk"])
def test_first_rows_of_keys_are_bounded_before_the_shuffle(spark, name):
    assert "Partial" in [x for x in plan_of(spark, name).split("\n") if "WindowGroupLimit" in x][-1]


@needs_data
@pytest.mark.parametrize("name, scans", [("coverage_report", 1), ("trailing_windows", 1), ("acceptance", 2)])
def test_windows_read_their_table_once(spark, name, scans):
    assert plan_of(spark, name).count("FileScan parquet") == scans


def test_a_mail_is_sent_again_after_a_lost_connection(monkeypatch):
    import smtplib

    from noticelake.operators import summaries

    said = []

    class Server:
        def __init__(self, host, port, timeout):
            said.append((host, port))
            if len(said) == 1:
                raise ConnectionRefusedError

        def __enter__(self):
            return self

        def __exit__(self, *args):
            return False

        def __getattr__(self, name):
            return lambda *args: said.append((name, *args))

    monkeypatch.setattr(smtplib, "SMTP", Server)
    mail = summaries.digest_message("a@x.org", ["b@x.org"], "Digest", "<p>x</p>")
    summaries.send(mail, "h", login=("u", "p"), wait=0)
    assert said == [("h", 587), ("h", 587), ("starttls",), ("login", "u", "p"), ("send_message", mail)]
    said.clear()
    with pytest.raises(ConnectionRefusedError):
        summaries.send(mail, "h", attempts=1)

"""Items against the index of their text, chunks and lists in linear time, against plain versions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from noticelake.operators import documents, evidence, requirements
from noticelake.sources import files


def key(x):
    return " ".join(re.findall("[a-z0-9]+", (x or "").lower()))


def plainly(item, text):
    k, t = key(item), key(text)
    if not k or not t:
        return False
    dates = [key(d) for d in re.findall(evidence.DATE_HINT, item)]
    tokens = [w for w in k.split(" ") if len(w) >= 4]
    return k in t or any(d in t for d in dates) or (bool(tokens) and sum(w in t for w in tokens) >= min(2, len(tokens)))


def some_text(rng, n):
    parts = ["a", "bb", "ccc", "dddd", "hosting", "host", "stin", "2026-01-30", "12 March 2025", "2 March 2025", "x2026", "01", "30", "1 2 3 4 5", "ab", "bc", "É", "--", "tings", "12026 01 301"]
    return rng.choice(["", " "]).join(rng.choice(parts) + rng.choice(["", " ", " ", ", "]) for _ in range(n))


def test_support_equals_a_search_for_each_item(spark):
    rng, rows = random.Random(3), []
    for k in range(120):
        text = some_text(rng, rng.randrange(0, 40))
        items = [some_text(rng, rng.randrange(0, 4)) for _ in range(12)] + ["", None, text[5:25], text[3:9], "by 2026-01-30", "1 2 3", "2 3 4 5", "b c"]
        rows.append((k, items, text))
    rows += [(500, ["a"], None), (501, None, "text"), (502, [], "text")]
    d = spark.createDataFrame(rows, "k long, items array<string>, text string")
    got = {r["k"]: r["ok"] for r in d.select("k", evidence.supported(F.col("items"), F.col("text")).alias("ok")).collect()}
    yes = 0
    for k, items, text in rows:
        expected = None if items is None else [plainly(i, text) if i is not None else False for i in items]
        assert got[k] == expected, (items, text)
        yes += sum(expected or [])
    assert 300 < yes < 2000
    one = d.filter("k < 20").select("k", F.posexplode("items").alias("i", "item"), "text").select("k", "i", requirements.has_evidence(F.col("item"), F.col("text")).alias("ok"))
    assert all(r["ok"] == got[r["k"]][r["i"]] for r in one.collect())


def took(call, *args):
    began = time.perf_counter()
    call(*args)
    return time.perf_counter() - began


def test_costs_grow_as_the_text_does():
    """Twice the lines against their document, twice the text in chunks: some twice the time."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    lines = [" ".join(word() for _ in range(8)) for _ in range(32_000)]
    missing = [" ".join(word() + "q" for _ in range(8)) + " 2026-01-30" for _ in range(32_000)]  # no token is found
    shorts = [" ".join(rng.choice("abc") for _ in range(6)) for _ in range(32_000)]

    def ask(n):
        index = evidence.EvidenceIndex(key("\n".join(lines[:n] + shorts[:n])))
        for item in lines[:n] + missing[:n] + shorts[:n]:
            index.supports(key(item), ["2026 01 30"])

    ask(1000)
    assert took(ask, 32_000) < 4 * took(ask, 16_000)
    text = "\n".join(lines) * 8
    assert took(documents.chunk, text, 1200, 150) < 1.5 and len(text) > 8_000_000


def test_large_texts_in_rows(spark):
    """A text of 4 MB, its chunks and its lines against it."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(20_000)]
    text = "\n".join(" ".join(rng.choices(words, k=10)) for _ in range(70_000))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string").select("doc_id", "text", documents.line_list(F.col("text")).alias("items"))
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    run(documents.chunks(d.limit(1), "doc_id"))
    assert took(run, documents.chunks(d, "doc_id")) < 6
    told = d.select(F.explode(evidence.with_support(F.col("items"), F.col("text"), lambda x: x["line"])).alias("x")).agg(F.count("*").alias("n"), F.count_if("x.ok").alias("ok"))
    began = time.perf_counter()
    r = told.first()
    assert r["n"] == r["ok"] == 70_000 and time.perf_counter() - began < 30
    found = documents.chunks(d, "doc_id", most=1200, overlap=150).orderBy("chunk").collect()
    assert [(r["start"], r["stop"]) for r in found] == documents.chunk(text, 1200, 150) and all(r["text"] == text[r["start"] : r["stop"]].strip() for r in found)


def test_first_of_each_key(spark):
    rng = random.Random(6)
    rows = [(k, [rng.choice(["A b", "a-b", "c", "C!", "", "--", "d e", None]) for _ in range(rng.randrange(0, 12))]) for k in range(80)] + [(99, None)]
    d = spark.createDataFrame(rows, "k long, items array<string>")
    got = {r["k"]: r["x"] for r in d.select("k", requirements.ordered_distinct(F.col("items")).alias("x")).collect()}
    for k, items in rows:
        seen, expected = set(), []
        for x in items or []:
            if key(x) and key(x) not in seen:
                seen.add(key(x))
                expected.append(x)
        assert got[k] == (None if items is None else expected)
    many = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda x: F.concat(F.lit("item "), x.cast("string"))).alias("xs"))
    began = time.perf_counter()
    assert many.select(F.size(requirements.ordered_distinct(F.col("xs"))).alias("n")).first()["n"] == 30_000 and time.perf_counter() - began < 5


@pytest.mark.parametrize("text, expected", [
    ("&#38;lt; and &lt;", "&lt; and <"), ("&#38;amp;", "&amp;"), ("&amp;lt;", "&lt;"), ("&#150;&#x80;", "–€"), ("a &amp b &unknown; c", "a &amp b &unknown; c"), ("&hearts;&NotEqualTilde;", "♥≂̸"), ("&#0;&#xD800;&#x110000;", "�" * 3),
    ("&eacute;" * 50_000, "é" * 50_000), ("no", "no"), (None, None), ("&", "&"),
])
def test_references_are_decoded_once(spark, text, expected):
    import html

    got = spark.createDataFrame([(text,)], "t string").select(files.decoded_entities(F.col("t")).alias("x")).first()["x"]
    assert got == expected
    if text and "&amp b" not in text:
        assert got == html.unescape(text).replace("\xa0", " ")

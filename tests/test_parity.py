"""Every registered query with SQL against DuckDB on the small tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from noticelake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, int | float) or hasattr(v, "item"):
        return round(float(v), 6)
    return v


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_html_text(spark):
    """The one query without SQL, against a parser of the standard library."""
    from html.parser import HTMLParser

    assert sorted(set(catalog.QUERIES) - set(catalog.SQL)) == ["html_text_extract"]
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.words = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.skip:
                self.words += data.split()

    for r in catalog.QUERIES["html_text_extract"](spark, str(DATA)).collect():
        parser = Words()
        parser.feed(pages[r["page_id"]])
        assert "".join(r["text"].split()) == "".join(parser.words)


def equals_sql(spark, folder, name, table, made: pd.DataFrame):
    """A query against its SQL on a table of few rows."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.register("made", made)
    con.execute(f"COPY made TO '{folder}/{table}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    ours, theirs = catalog.QUERIES[name](spark, str(folder)).toPandas(), con.execute(catalog.SQL[name]).df()
    assert rows(ours) == rows(theirs)
    return ours


def test_pages_that_share_a_url(spark, tmp_path):
    urls = {22: "a", 31: "a", 8: "a", 15: "b", 16: "b", 4: "c", 12: "c", 40: None, 41: None, 42: None} | {n: f"u{n}" for n in range(50, 70)}
    got = equals_sql(spark, tmp_path, "fetch_plan", "pages", pd.DataFrame({"page_id": list(urls), "url": list(urls.values()), "html": ""}))
    said = {r.page_id: (r.action, r.if_none_match) for r in got.itertuples()}
    assert len(got) == len(urls) and said[22] == ("reuse", "e1") and said[8] == ("download", "e1") and said[4] == ("download", None) and said[42] == ("download", None)


@pytest.mark.parametrize("name", ["reject_report", "rule_cascade", "term_hits"])
def test_words_beside_letters_outside_ascii(spark, tmp_path, name):
    """The edge of a word is where letters of ASCII, digits and _ end: in titles and in bodies, for patterns and terms."""
    beside = [f"{a}{{}}{b}" for x in ("ß", "æ", "œ", "ø", "и", "λ", "中", "٣", "_", "2", "-", "") for a, b in ((x, ""), ("", x), (x, x))]
    titles, bodies = ["in", "der", "aux", "enes", "acan"], ["tion", "hation", "pour", "ederwh", "estou", "ndtion"]
    texts = [f"{w.format(t)} x\nx" for w in beside for t in titles] + [f"x\nx {w.format(t)} x" for w in beside for t in bodies]
    ids = range(1, 5 * len(texts), 5)
    equals_sql(spark, tmp_path, name, "documents", pd.DataFrame({"doc_id": ids, "text": texts, "n_chars": [len(t) for t in texts]}))

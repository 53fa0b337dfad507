import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticelake.functions import numbers, text, urls


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


def model(x):
    for c in text.APOSTROPHES:
        x = x.replace(c, "'")
    x = unicodedata.normalize("NFKD", x.lower())
    return " ".join("".join(c for c in x if not unicodedata.combining(c)).split())


def test_normalize_text_against_a_model(spark):
    cases = ["L’été À  Montréal", "Çà et là", "ﬁn™ d’État", "", "Straße ½ ²", "a\tb\nc", "ÉCOLE"]
    got = [r["x"] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", text.normalize_text(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [model(c) for c in cases]


def test_normalize_text_property(spark):
    seen = []

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x17F), max_size=20))
    def gather(x):
        seen.append(x)

    gather()
    got = spark.createDataFrame(list(enumerate(seen)), "i int, t string").select("i", text.normalize_text(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [model(c) for c in seen]


def test_language(spark):
    assert one(spark, text.detect_language(F.col("t")), t="Les exigences de la soumission") == "fr"
    assert one(spark, text.detect_language(F.col("t")), t="The requirements are listed") == "en"
    assert one(spark, text.detect_language(F.col("t")), t="12345 67") is None


def test_pii(spark):
    got = one(spark, text.scrub_pii(F.col("t")), t="Mail jo.do@example.org or call 613-555-1234 by 2026-01-30")
    assert got == "Mail [REDACTED_EMAIL] or call [REDACTED_PHONE] by 2026-01-30"


def test_mojibake(spark):
    assert one(spark, text.repair_mojibake(F.col("t")), t="MontrÃ©al") == "Montréal"
    assert one(spark, text.repair_mojibake(F.col("t")), t="Âme 漢") == "Âme 漢"
    assert one(spark, text.repair_leniently(F.col("t")), t="lâ\x80\x99offre ÃƒÂ©") == "l’offre ©"
    assert one(spark, text.repair_leniently(F.col("t")), t="plain é") == "plain é"


def test_headings(spark):
    d = spark.createDataFrame([("1.2 Scope of work",), ("KEY DATES",), ("Dates:",), ("plain words here",), ("",)], "t string").select(text.looks_like_heading(F.col("t")).alias("x"))
    assert [r["x"] for r in d.collect()] == [True, True, True, False, False]


def test_urls(spark):
    assert one(spark, urls.normalize_url(F.col("t")), t="HTTP://u:p@Example.ORG:80/A?b=2&a=1&c=#x") == "http://example.org:80/A?a=1&b=2"
    assert one(spark, urls.normalize_url(F.col("t")), t="example.org/x") == "http://example.org/x"
    assert one(spark, urls.normalize_url(F.col("t")), t="http://e.org/?b=a%20b&a=%7E") == one(spark, urls.normalize_url(F.col("t")), t="http://e.org/?a=~&b=a+b")
    assert one(spark, F.array_join(urls.extract_urls(F.col("t")), " "), t="see https://a.b/c). and https://a.b/c, https://d.e") == "https://a.b/c https://d.e"
    assert one(spark, urls.normalize_etag(F.col("t")), t='W/"abc"') == "abc"


def test_timestamps(spark):
    for raw in ("2026-01-30T10:00:00", "2026-01-30 10:00", "2026-01-30T10:00:00+00:00"):
        assert str(one(spark, numbers.parse_timestamp(F.col("t")), t=raw)) == "2026-01-30 10:00:00"
    assert one(spark, numbers.parse_timestamp(F.col("t")), t="soon") is None


def test_vectors(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0, 5.0]), ([1.0, 0.0], [-1.0, 0.0]), ([], [1.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [r["x"] for r in d.select(numbers.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 0.0, 0.0, 0.0]
    assert one(spark, numbers.semantic_score(F.col("t").cast("double"), F.lit(10)), t="0.825") == 92  # half to even

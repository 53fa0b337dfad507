"""Text functions as column expressions; everything runs in the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signs that stand for an apostrophe.
APOSTROPHES = "’‘ʼ′`´"

# French words counted by the language test, and its accented letters.
FRENCH_STOPWORDS = ("le", "la", "les", "des", "du", "de", "et", "ou", "pour", "avec", "sans", "soumission", "exigences", "criteres", "cloture", "date", "delai")
FRENCH_ACCENTS = "àâçéèêëîïôûùüÿœ"

# Patterns of e-mail addresses and phone numbers.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\b(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b"


@lru_cache
def folding() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose to one base character, their bases, and those that decompose to more, by rule over Unicode."""
    one, base, more = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c) in ("Cn", "Cs", "Co") or 0xAC00 <= code <= 0xD7A3:
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c and code < 0x2000:
            one.append(c)
            base.append(plain)
        elif len(plain) > 1 and (code < 0x250 or 0x2000 <= code < 0x2150 or 0xFB00 <= code < 0xFB07):
            more[c] = plain
    return "".join(one), "".join(base), more


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the columns, computed once for each row: a one-row generator, through which no later filter is pushed."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def strip_accents(x: Column) -> Column:
    one, base, more = folding()
    x = F.regexp_replace(F.translate(x, one, base), r"\p{M}+", "")
    some = x
    for c, plain in more.items():
        some = F.replace(some, F.lit(c), F.lit(plain))
    return F.when(x.rlike("[" + "".join(more) + "]"), some).otherwise(x)


def squeeze(x: Column) -> Column:
    """White space runs to one space, ends trimmed; white space as Unicode has it."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def trimmed(x: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def plain_apostrophes(x: Column) -> Column:
    return F.translate(x, APOSTROPHES, "'" * len(APOSTROPHES))


def blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def normalize_text(x: Column) -> Column:
    """Lower case without accents, apostrophes alike, white space squeezed; null becomes empty."""
    return squeeze(strip_accents(F.lower(plain_apostrophes(blank(x)))))


@lru_cache
def marks() -> re.Pattern:
    return re.compile("[" + "".join(chr(c) for c in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(c))) + "]")


SIGNS = str.maketrans(dict.fromkeys(APOSTROPHES, "'"))


def plain_text(x: str | None) -> str:
    """What normalize_text gives, for functions that hold the text in Python already."""
    low = (x or "").translate(SIGNS).lower()
    if not low.isascii():
        low = marks().sub("", unicodedata.normalize("NFKD", low))
    return " ".join(low.split())


def soft_normalize(x: Column) -> Column:
    """As normalize_text, accents kept."""
    return squeeze(F.lower(plain_apostrophes(blank(x))))


def match_key(x: Column) -> Column:
    """Only a-z and 0-9, in lower case, other runs as one space."""
    return F.trim(F.regexp_replace(F.lower(blank(x)), "[^a-z0-9]+", " "))


def first_nonempty(*columns: Column) -> Column:
    trimmed = [F.trim(blank(c)) for c in columns]
    return F.coalesce(*[F.when(c != "", c) for c in trimmed], F.lit(""))


def detect_language(x: Column) -> Column:
    """null without ASCII letters; fr with three stopwords, or an accent and one; else en."""
    lower = F.lower(blank(x))
    tokens = F.regexp_extract_all(lower, F.lit("[a-zA-Z]+"), F.lit(0))
    hits = F.size(F.filter(tokens, lambda t: t.isin(*FRENCH_STOPWORDS)))
    french = (hits >= 3) | (lower.rlike(f"[{FRENCH_ACCENTS}]") & (hits >= 1))
    return F.when(F.size(tokens) == 0, F.lit(None).cast("string")).when(french, "fr").otherwise("en")


def scrub_pii(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, EMAIL, "[REDACTED_EMAIL]"), PHONE, "[REDACTED_PHONE]")


def html_escape(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def truncate(x: Column, most: int) -> Column:
    """At most so many characters, cut at the last space that leaves something, with three dots."""
    head = F.substring(x, 1, most - 3)
    at_space = F.regexp_extract(head, r"(?s)^(.*\S)\s", 1)
    return F.when(F.char_length(x) <= most, x).otherwise(F.concat(F.when(at_space != "", at_space).otherwise(head), F.lit("...")))


def cut_at_space(x: Column, most: int) -> Column:
    """At most so many characters, cut at the last space that leaves something; no dots."""
    head = F.substring(x, 1, most)
    at_space = F.trim(F.regexp_extract(head, "(?s)^(.*) ", 1))
    return F.when(F.char_length(x) <= most, x).otherwise(F.when(at_space != "", at_space).otherwise(F.trim(head)))


def repair_mojibake(x: Column) -> Column:
    """UTF-8 that was read as Latin-1: turned back if the whole text allows it, else unchanged."""
    suspect = x.rlike("[ÃÂâ]") & x.rlike("^[\u0001-ÿ]*$")
    turned = F.try_validate_utf8(F.when(suspect, F.encode(x, "ISO-8859-1")).cast("string"))
    return F.coalesce(turned, x)


# What shows that a text was read wrongly; sequences left by a second wrong reading, and what they stood for.
SUSPECT = "â€|Ã|Â|¤"
LEFTOVERS = (("â€™", "’"), ("â€“", "“"), ("â€\u009d", "”"), ("â€\u0098", "‘"), ("â€\u0099", "’"), ("â€–", "–"), ("â€—", "—"), ("Â ", " "), ("Â", ""))


def repair_leniently(x: Column) -> Column:
    """UTF-8 read as Latin-1 turned back, what cannot be turned left out; then the known leftovers replaced."""
    narrow = F.regexp_replace(x, "[^\u0001-ÿ]", "")
    turned = F.replace(F.make_valid_utf8(F.when(x.rlike(SUSPECT), F.encode(narrow, "ISO-8859-1")).cast("string")), F.lit("\ufffd"), F.lit(""))
    x = F.coalesce(F.nullif(turned, F.lit("")), x)
    for wrong, right in LEFTOVERS:
        x = F.replace(x, F.lit(wrong), F.lit(right))
    return x


def looks_like_heading(line: Column) -> Column:
    numbered = line.rlike(r"^\d+(\.\d+)*\.?\s+\S")
    shouted = (line == F.upper(line)) & (line != F.lower(line)) & (F.char_length(line) > 4)
    return (F.char_length(line) <= 120) & (line != "") & (numbered | line.endswith(":") | shouted)


def json_object(x: Column) -> Column:
    """The text from the first brace to the last, or null."""
    found = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)




def listed(values: Column, most: int = 3) -> Column:
    """Joined by commas, with a count of what is left out."""
    more = F.size(values) - most
    return F.concat(F.array_join(F.slice(values, 1, most), ", "), F.when(more > 0, F.concat(F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))

"""Links: extraction, normal forms, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, first_nonempty

LINK = r"https?://[^\s<>\"']+"


def extract_urls(x: Column) -> Column:
    """Links of a text in order, each once, closing marks cut off; if there is none, its comma- or line-separated parts."""
    found = F.transform(F.regexp_extract_all(blank(x), F.lit(LINK), F.lit(0)), lambda u: F.regexp_replace(u, r"[).,;\]]+$", ""))
    parts = F.filter(F.transform(F.split(blank(x), "[\n,]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.when(F.size(found) > 0, found).otherwise(parts))


def best_url(english: Column, french: Column, attachments: Column) -> Column:
    linked = F.get(F.filter(F.split(blank(attachments), "\n"), lambda p: F.trim(p).startswith("http")), F.lit(0))
    return first_nonempty(english, french, linked)


def recoded(pair: Column) -> Column:
    """A query's name or value pair written in one way: what is encoded needlessly, or otherwise than usual, comes out alike."""
    part = lambda p: F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(p), p)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    at = F.instr(pair, "=")
    return F.when(pair.rlike("[^A-Za-z0-9=._~-]"), F.concat(part(F.substring(pair, F.lit(1), at - 1)), F.lit("="), part(F.substring(pair, at + 1, F.length(pair))))).otherwise(pair)


def normalize_url(x: Column) -> Column:
    """Lower-case scheme (http if none) and host, port kept, query parts in order, no fragment or user."""
    whole = F.when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), x).otherwise(F.concat(F.lit("http://"), F.regexp_replace(x, "^//", "")))
    scheme = F.lower(F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_replace(F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), "^.*@", ""))
    path = F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(whole, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.array_sort(F.transform(F.filter(F.split(query, "&"), lambda p: p.rlike("=.")), recoded))
    return F.concat(scheme, F.lit("://"), host, path, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit("")))


def file_name(x: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(x, r"[?#].*$", ""), "/"), -1)


def normalize_etag(x: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(F.trim(x), "^[Ww]/", ""), F.lit('"'), F.lit("")))


def fingerprint(url: Column, etag: Column, modified: Column, name: Column, size: Column, content: Column) -> Column:
    """By content if its hash is known, else by what the server told."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    by_content = F.concat_ws("|", text(url), text(content), text(name), text(size))
    by_meta = F.concat_ws("|", text(url), text(etag), text(modified), text(name), text(size))
    return F.sha2(F.when(text(content) != "", by_content).otherwise(by_meta), 256)


def display_url(x: Column) -> Column:
    """The first link of a text without its query, for display."""
    return F.regexp_replace(F.element_at(F.split(F.trim(x), r"\s+"), 1), r"[?#].*$", "")

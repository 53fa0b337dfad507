"""Numbers, dates and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date patterns tried in turn; a value without zone is UTC (the session's zone).
PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd'T'HH:mm[XXX]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd[ HH:mm:ss]", "yyyy/MM/dd HH:mm", "MM/dd/yyyy[ HH:mm:ss]", "d MMM yyyy[ HH:mm[:ss]]",
    "d MMMM yyyy[ HH:mm[:ss]]", "MMMM d, yyyy[ HH:mm[:ss]]", "MMM d, yyyy[ HH:mm[:ss]]", "d-MMM-yyyy", "yyyyMMdd", "yyyyMMdd'T'HHmmss[XXX]",
)
#: A day's name before a date says nothing more.
DAY_NAME = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+"


def parse_timestamp(x: Column) -> Column:
    plain = F.regexp_replace(F.trim(x), DAY_NAME, "")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(p)) for p in PATTERNS])


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def days_left(close: Column, as_of: Column) -> Column:
    return F.floor((F.unix_timestamp(close) - F.unix_timestamp(as_of)) / 86400)


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole * 100, 2))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Clamped to 0..1; 0 for empty or zero vectors."""
    size = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), size), F.slice(b, F.lit(1), size)
    product = F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, p: t + p)
    lengths = norm(x) * norm(y)
    return F.when((size <= 0) | (lengths == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), product / lengths)))


def evidence_score(it: Column, erp: Column, transform: Column, allow: Column) -> Column:
    """8 for any IT hit, up to 18 for domain hits, up to 15 for transformation hits, 6 for an allow-listed title."""
    return F.when(it > 0, 8).otherwise(0) + F.least(F.lit(18), 6 * erp) + F.least(F.lit(15), 5 * transform) + F.when(allow > 0, 6).otherwise(0)


def semantic_score(similarity: Column, evidence: Column) -> Column:
    return F.least(F.lit(120), F.bround(100 * similarity, 0).cast("int") + evidence).cast("int")


def any_signal(values: Column) -> Column:
    """Whether any list of a map of lists has an element."""
    return F.exists(F.map_values(values), lambda x: F.size(x) > 0)


def merged_maps(defaults: Column, override: Column) -> Column:
    """A map with the values of override where it has the key and a value, else of defaults."""
    return F.map_zip_with(defaults, override, lambda _, a, b: F.coalesce(b, a))


def deep_merge(defaults: dict, override: dict) -> dict:
    """Nested settings, on the driver: override wins, dictionaries are merged."""
    both = {k: deep_merge(v, override[k]) if isinstance(v, dict) and isinstance(override.get(k), dict) else override.get(k, v) for k, v in defaults.items()}
    return both | {k: v for k, v in override.items() if k not in defaults}


def local_time(at: Column, zone: str) -> Column:
    """A UTC time as the clock of a zone shows it (no zone)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), at.cast("timestamp_ntz"))

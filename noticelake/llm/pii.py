"""Personal data found by regular expressions, confirmed by checksums, scored by nearby words. DataFrame functions only.

A pattern marks its matches in the text (leftmost, not overlapping); cutting at the marks gives the text between and the
matches in turn, so positions are running sums of lengths in code points. A match stands if its validator does: parts of an IP
address at most 255, Luhn for card numbers, digit counts for phone numbers, mod 97 for account numbers (IBAN) and French
numbers, the letter of mod 23 for Spanish ones, ranges for US ones, letters and digits mixed for secrets. The score of a span
starts at its kind's prior and rises by `RAISE` if a context word stands within `WINDOW` characters of text next to it. Kinds
whose form alone says little have priors below the least score: there the context decides.

The patterns are written so that they run in time proportional to the text: possessive repeats, and starts only where a run
begins or a match has just ended (\\G). They find what the plain patterns find. Running sums are taken in chunks, so a text
with many spans costs no square of their number; masks are put together from the same pieces.

Nulls: a null text is empty and has no spans; a null doc_id is kept. Repeated rows are scanned each; ties of start go by kind.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of text before and after a match in which context words count, and by how much they raise a score.
WINDOW, RAISE = 48, 0.3
MARK, OTHER = "\u0001", "\u0002"
LOCAL = "A-Za-z0-9._%+-"

# The length of account numbers by country, from the IBAN registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_body() -> str:
    """Account numbers of their country's length, solid or in groups of four, so that groups after them are not taken in."""
    ways = []
    for n, countries in IBAN_LENGTHS.items():
        fours, rest = divmod(n - 4, 4)
        ways.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{n - 4}}}|(?: [A-Z0-9]{{4}}){{{fours}}}" + (f" [A-Z0-9]{{{rest}}})" if rest else ")"))
    return f"(?:{'|'.join(ways)})"


ALONE, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
IBAN, NIR, DNI, SSN, SECRET = iban_body(), "[12][0-9]{2}(?:0[1-9]|1[0-2])[0-9]{10}", "[0-9]{8}-?[A-Z]", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "[A-Za-z0-9_]{20,}"
PASSWORD = r"(?i:password|passwd|passwort|contrase\x{f1}a|mot de passe)[ \t]*[:=][ \t]*[^ \t\r\n]+"

# For each kind its pattern, a pattern that any text with a match has ("" if none is cheaper), prior score, context words.
KINDS = {
    "email": (rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.7, "mail|contact|courriel|correo|kontakt"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, "ip|host|server|address|adresse|login"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", "", 0.7, "card|visa|master|credit|carte|karte|tarjeta|pay"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, "tel|phone|call|fax|mobil|whatsapp|ruf"),
    "iban": (f"{ALONE}{IBAN}{END}", "[A-Z]{2}[0-9]{2}", 0.7, "iban|account|bank|konto|compte|cuenta"),
    "nir": (f"{ALONE}{NIR}{END}", "", 0.45, "nir|insee|sécu|social|numéro"),
    "dni": (f"{ALONE}{DNI}{END}", "[0-9]{8}-?[A-Z]", 0.45, "dni|nif|documento|identidad"),
    "ssn": (f"{ALONE}{SSN}{END}", "[0-9]{3}-[0-9]{2}-", 0.4, "ssn|social|security|taxpayer"),
    "secret": (f"{ALONE}{SECRET.replace('{20,}', '{20,}+')}", "[A-Za-z0-9_]{20}", 0.3, "token|secret|key|credential|bearer|auth|passw|schl|clave|clé"),
    "password": (f"{ALONE}{PASSWORD}", "[:=]", 0.6, "login|user|account|benutzer|usuario|utilisateur"),
}
NAMES = list(KINDS)
BASE = ("email", "ip", "card", "phone")
BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    n = F.length(x)

    def add(total, i):
        d = F.substring(x, n + 1 - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(x: Column) -> Column:
    solid = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(solid, F.lit(5), F.length(solid)), F.substring(solid, 1, 4))

    def add(rest, i):
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


#: Fixed value: the letters of Spanish numbers, by the remainder of 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def stands(kind: str, x: Column) -> Column:
    """Whether the match is confirmed."""
    if kind == "ip":
        return x.rlike(rf"^(?:(?:{BYTE})\.){{3}}{BYTE}$".replace("0*+", "0*"))
    if kind == "card":
        return luhn(digits(x))
    if kind == "phone":
        return F.length(digits(x)).between(9, 15)
    if kind == "iban":
        return mod97(x)
    if kind == "nir":
        return 97 - F.substring(x, 1, 13).cast("long") % 97 == F.substring(x, 14, 2).cast("long")
    if kind == "dni":
        return F.substring(F.lit(DNI_LETTERS), (F.substring(x, 1, 8).cast("int") % 23 + 1).cast("int"), F.lit(1)) == F.right(x, F.lit(1))
    if kind == "ssn":
        return x.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    if kind == "secret":
        return x.rlike("[0-9]") & x.rlike("[A-Za-z]")
    return F.lit(True)


def pieces(kind: str, text: Column) -> Column:
    """The text cut at its matches: text and match in turn; null if there can't be any."""
    pattern, needs = KINDS[kind][:2]
    cut = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)
    return F.when(F.contains(text, F.lit(needs)) if needs == "@" else text.rlike(needs), cut) if needs else cut


def score(kind: str, before: Column, after: Column) -> Column:
    _, _, prior, words = KINDS[kind]
    near = F.lower(F.concat(F.right(before, F.lit(WINDOW)), F.lit(" "), F.left(after, F.lit(WINDOW))))
    return F.when(near.rlike(rf"\b(?:{words})"), min(1.0, prior + RAISE)).otherwise(prior)


#: Numbers summed at a time: a running sum of n costs some n * CHUNK + (n / CHUNK)^2 steps.
CHUNK = 256
BLANK = "named_struct('start', 0L, 'kind', 0, 'stop', 0L, 'score', 0.0D)"


def sums_before(numbers: Column) -> Column:
    """For each number the sum of those before it."""
    zero = lambda at: F.struct(at.alias("at"), F.expr("slice(array(0L), 1, 0)").alias("all"))
    add = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all"))
    fold = lambda x, at: F.aggregate(x, zero(at), add, lambda s: s["all"])
    chunked = lambda ns: F.transform(F.sequence(F.lit(0), F.floor((F.size(ns) - 1) / CHUNK).cast("int")), lambda k: F.slice(ns, k * CHUNK + 1, CHUNK))
    totals = lambda c: F.transform(c, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda t, n: t + n))
    return let(let(numbers, chunked), lambda c: F.flatten(F.zip_with(c, fold(totals(c), F.lit(0).cast("long")), fold)))


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans_of(kind: str, cut: Column) -> Column:
    """array<struct<start, kind, stop, score>> of the confirmed matches, from the text cut at the marks."""
    at = NAMES.index(kind)
    lengths = F.transform(cut, lambda x: F.char_length(x).cast("long"))

    def listed(starts: Column) -> Column:
        def one(i):
            return F.struct(F.get(starts, i).alias("start"), F.lit(at).alias("kind"), F.get(starts, i + 1).alias("stop"), score(kind, F.get(cut, i - 1), F.get(cut, i + 1)).alias("score"))

        odd = F.filter(F.sequence(F.lit(1), F.size(cut) - 2, F.lit(2)), lambda i: stands(kind, F.get(cut, i)))
        return F.transform(odd, one)

    return F.when(F.size(cut) > 1, let(sums_before(lengths), listed)).otherwise(F.expr(f"slice(array({BLANK}), 1, 0)"))


def find_spans(docs: DataFrame, kinds: list[str] | None = None, to: str = "spans") -> DataFrame:
    """docs with a column more: array<struct<start, kind, stop, score>>, by start, then kind; kind is an index into NAMES."""
    kinds = NAMES if kinds is None else kinds
    kept = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    plain = docs.select(kept.alias("__row"), F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), MARK, OTHER).alias("__plain"))
    cut = plain.select("__row", *[pieces(k, F.col("__plain")).alias(f"__{k}") for k in kinds])
    found = cut.select("__row", *[spans_of(k, F.col(f"__{k}")).alias(f"__{k}") for k in kinds])
    return found.select("__row.*", F.sort_array(F.concat(*[F.col(f"__{k}") for k in kinds])).alias(to))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def personal_data(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """A row for each document: counts of the base kinds, digest of the base spans, all spans as a string, their number, their
    scores in hundredths as a string, and the spans with scores.

    Base spans stay whatever their score; spans of other kinds need least_score.
    """
    base = [NAMES.index(k) for k in BASE]
    found = find_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).drop("text")
    found = found.withColumn("found", F.filter("spans", lambda s: s["kind"].isin(base) | (s["score"] >= least_score)))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == NAMES.index(k))).cast("long").alias(f"n_{k}")
    scores = F.array_join(F.transform("found", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    digest = F.sha2(span_text(F.filter("found", lambda s: s["kind"].isin(base))), 256)
    return found.select("doc_id", *[count(k) for k in BASE], digest.alias("base_sha256"), span_text(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"), scores.alias("scores"), F.col("found").alias("scored"))


#: The order in which kinds are masked: longer forms before those that may lie inside them.
MASK_ORDER = ("email", "password", "iban", "secret", "nir", "card", "phone", "ip", "ssn", "dni")


def masked(docs: DataFrame, kind: str, least_score: float) -> DataFrame:
    """docs with the kind's confirmed spans of __plain replaced by its name in angle brackets."""
    cut = F.col("__cut")

    def part(x, i):
        stays = F.lit(kind in BASE) | (score(kind, F.get(cut, i - 1), F.get(cut, i + 1)) >= least_score)
        return F.when((i % 2 == 1) & stands(kind, x) & stays, F.lit(f"<{kind.upper()}>")).otherwise(x)

    whole = F.when(F.size(cut) > 1, F.array_join(F.transform(cut, part), "")).otherwise(F.col("__plain"))
    return docs.withColumn("__cut", pieces(kind, F.col("__plain"))).select("__row", whole.alias("__plain"))


def mask_documents(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The same documents with personal data masked, kind by kind (what one mask has taken no other can match); n_chars, if
    there, follows the text. Texts without personal data stay as they are, but for the character U+0001, which becomes U+0002
    in texts that are masked."""
    kept = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    found = docs.select(kept.alias("__row"), F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), MARK, OTHER).alias("__plain"))
    for kind in MASK_ORDER:
        found = masked(found, kind, least_score)
    whole = F.col("__row.text").cast("string")
    same = F.translate(whole, MARK, OTHER) == F.col("__plain")
    out = found.withColumn("__new", F.when(whole.isNotNull(), F.when(same, whole).otherwise(F.col("__plain"))))
    out = out.select(*[F.col("__new").alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

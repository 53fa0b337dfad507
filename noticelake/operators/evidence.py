"""Which items a text supports: an index of each text, built once, answers for all items.

A text in match form is a run of words of a-z and 0-9. The index holds its distinct words; the parts of them, by length, once a
part of that length is asked for; and the places of runs of words, by shape, once such a run is asked for. Each is made in time
linear in the text, and an item is answered from sets, so the cost is that of the text plus that of the items.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import match_key

DATE_HINT = r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}\s+[A-Za-z]{3,}\s+\d{4})\b"
#: Characters from which on a token of an item counts as evidence, and how many such tokens are enough.
LEAST_TOKEN, ENOUGH = 4, 2


class EvidenceIndex:
    """Answers whether a text in match form holds a token or a run of words, at any place, as parts of words too."""

    def __init__(self, text: str):
        self.text, self.words = text, text.split(" ") if text else []
        self.known = set(self.words)
        self.parts: dict[int, set[str]] = {}
        self.pairs: dict[tuple[int, int], set[str]] = {}
        self.runs: dict[tuple[int, int], dict[str, list[int]]] = {}

    def holds(self, phrase: str) -> bool:
        words = phrase.split(" ")
        return self.holds_token(phrase) if len(words) == 1 else self.holds_run(phrase, words)

    def holds_token(self, token: str) -> bool:
        if token in self.known:
            return True
        n = len(token)
        if n not in self.parts:
            self.parts[n] = {w[k : k + n] for w in self.known if len(w) > n for k in range(len(w) - n + 1)}
        return token in self.parts[n]

    def holds_run(self, phrase: str, words: list[str]) -> bool:
        """The first word may end one of the text, the last may begin one, those between are whole."""
        first = len(words[0])
        if len(words) == 2:
            shape = (first, len(words[1]))
            if shape not in self.pairs:
                self.pairs[shape] = {f"{a[-first:]} {b[: shape[1]]}" for a, b in zip(self.words, self.words[1:]) if len(a) >= first and len(b) >= shape[1]}
            return phrase in self.pairs[shape]
        whole = min(len(words) - 2, 2)  # words after the first that lead to the places
        anchor = " ".join(words[: whole + 1])
        return any(self.text.startswith(phrase, at) for at in self.places(first, whole).get(anchor, ()))

    def places(self, first: int, whole: int) -> dict[str, list[int]]:
        if (first, whole) not in self.runs:
            found: dict[str, list[int]] = {}
            at = 0
            for k, w in enumerate(self.words[: len(self.words) - whole]):
                if len(w) >= first:
                    found.setdefault(" ".join([w[-first:], *self.words[k + 1 : k + 1 + whole]]), []).append(at + len(w) - first)
                at += len(w) + 1
            self.runs[first, whole] = found
        return self.runs[first, whole]

    def supports(self, key: str, dates: list[str]) -> bool:
        """Whether the text holds an item's key, a date of it, or two (all, if fewer) of its tokens of four characters or more."""
        if not key or not self.text:
            return False
        tokens = [t for t in key.split(" ") if len(t) >= LEAST_TOKEN]
        if tokens:  # a text that holds the key holds them all
            missing = min(ENOUGH, len(tokens))
            for left, t in zip(range(len(tokens), 0, -1), tokens):
                if left < missing:
                    break
                missing -= self.holds_token(t)
                if not missing:
                    return True
        elif self.holds(key):
            return True
        return any(map(self.holds, dates))


def answered(texts: pa.Array, keys: pa.Array, dates: pa.Array) -> pa.Array:
    """For each text, whether it supports each of its items."""
    out = []
    for k in range(len(texts)):
        asked = keys[k].as_py()
        index = EvidenceIndex(texts[k].as_py() or "")
        out.append(None if asked is None else [index.supports(key or "", found or []) for key, found in zip(asked, dates[k].as_py())])
    return pa.array(out, pa.list_(pa.bool_()))


answered.__annotations__ = {"texts": pa.Array, "keys": pa.Array, "dates": pa.Array, "return": pa.Array}


def supported(items: Column, evidence: Column) -> Column:
    """array<boolean>: of each item of an array<string>, whether the evidence of the row supports it.

    Match forms and dates are found in the JVM; it has no expression that keeps an index of a row's text, and a search of the
    whole text for each item takes the product of both. A null or empty item or evidence gives false, null items give null.
    """
    dates = F.transform(items, lambda x: F.transform(F.regexp_extract_all(x, F.lit(f"({DATE_HINT})"), F.lit(1)), match_key))
    return F.arrow_udf(answered, "array<boolean>")(match_key(evidence), F.transform(items, match_key), dates)


def with_support(items: Column, evidence: Column, text=lambda x: x) -> Column:
    """array<struct<item, ok>>: items (text(item) is what counts) with their support."""
    return F.zip_with(items, supported(F.transform(items, text), evidence), lambda x, ok: F.struct(x.alias("item"), ok.alias("ok")))

"""Quality rules with cross-document line frequency.

Each text is split at line feeds; a line is normalised (A-Z to lower case, digits to 0, white space runs to one space) and
hashed. A line's frequency is the number of distinct documents of its host that hold it. Documents are told apart by their
whole text, so exact copies of one document count once and different documents that share most of their lines count each.
Lines above the limit are removed; a document that has lost more than a given share of its words is depleted and rejected,
as is one that fails the base rules.

Nulls: a null text has no words and fails the base rules; a null host is a host of its own; a null doc_id is kept as it is.
Repeated rows get the same verdict each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NAMED, SAME, Words, arrow_map, batch_of, join_on, looked_up, materialize, mix, sheltered, text_key

WHITE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
LINE_TABLE = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
FEATURES = "doc_id bigint, host string, text_key bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<struct<hash:bigint,words:int>>"


def repeat_words(words: Words, width: int = 3) -> np.ndarray:
    """By text: how many words lie in windows of `width` words that the text holds twice or more. Exact."""
    n, ids, doc = len(words.ids), words.ids, words.doc_of()
    out = np.zeros(len(words.offsets) - 1, np.int64)
    if n < width:
        return out
    inside = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    if not len(inside):
        return out
    columns = [doc[inside], *(ids[inside + k] for k in range(width))]
    keys = mix(columns[0].astype(np.uint64) + np.uint64(1))
    for c in columns[1:]:
        keys = mix(keys ^ c.astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    alike = keys[order][1:] == keys[order][:-1]
    same = alike.copy()
    for c in columns:
        same &= c[order][1:] == c[order][:-1]
    if (alike & ~same).any():  # two windows with one hash: order by the words themselves
        order = np.lexsort(columns[::-1])
        same = np.ones(len(order) - 1, bool)
        for c in columns:
            same &= c[order][1:] == c[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    steps = np.zeros(n + 1, np.int64)
    starts = inside[order[twice]]
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(steps[:-1]) > 0)])
    return covered[words.offsets[1:]] - covered[words.offsets[:-1]]


def features(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = pc.fill_null(batch.column("text"), "")
    words = Words(texts, SAME)
    word_chars, symbols, dup_lines, lines, bounds = [], [], [], [], [0]
    counts: list[int] = []
    for text in texts:
        raw = text.as_buffer().to_pybytes() if len(text.as_buffer() or b"") else b""
        solid = raw.translate(None, WHITE)
        word_chars.append(len(solid.translate(None, CONTINUATION)))
        symbols.append(len(raw) - len(raw.translate(None, SYMBOLS)))
        real = [x for x in raw.split(b"\n") if x.strip()]
        dup_lines.append(len(real) - len(set(real)))
        seen: dict[bytes, int] = {}
        for line in raw.translate(LINE_TABLE).split(b"\n"):
            if own := line.split():
                key = b" ".join(own)
                seen[key] = seen.get(key, 0) + len(own)
        lines += [xxhash.xxh3_64_intdigest(k) for k in seen]
        counts += seen.values()
        bounds.append(len(lines))
    hashes = np.array(lines, np.uint64).view(np.int64)
    structs = pa.StructArray.from_arrays([pa.array(hashes), pa.array(np.array(counts, np.int32))], ["hash", "words"])
    return batch_of(
        ["doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
        [batch.column("doc_id"), batch.column("host"), batch.column("text_key"), words.counts, np.array(word_chars, np.int64), np.array(symbols, np.int64), np.array(dup_lines, np.int64), repeat_words(words), pa.ListArray.from_arrays(pa.array(np.array(bounds, np.int32)), structs)],
    )


def line_features(docs: DataFrame, host: str = "source") -> DataFrame:
    """A row for each document: base counts, and each distinct normalised line's hash with its words."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    return arrow_map(narrow, features, FEATURES)


def frequent_lines(found: DataFrame, least_docs: int, share: float) -> DataFrame:
    """(host, hash) of lines that more distinct documents of the host hold than max(least_docs, share of its documents).

    The distinct count is taken in two steps (by host, line and document, then by host and line), so that a line that a
    third of all documents hold is summed on the map side first.
    """
    limit = found.groupBy("host").agg(F.greatest(F.lit(float(least_docs)), F.count_distinct("text_key") * F.lit(share)).alias("limit"))
    held = found.select("host", "text_key", F.explode("lines.hash").alias("hash")).groupBy("host", "hash").agg(F.count_distinct("text_key").alias("docs")).filter(F.col("docs") > least_docs)
    return join_on(held, limit, ["host"], "inner").filter(F.col("docs") > F.col("limit")).select("host", "hash")


def quality_rules(docs: DataFrame, host: str = "source", least_docs: int = 20, share: float = 0.02, depleted: float = 0.5, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """A row for each document: the base counts, base_failed, kept, n_removed_words and the hashes of its removed lines.

    A line is above the limit if more than max(least_docs, share of the host's documents) distinct documents of the host
    hold it. A document is depleted if removed lines held more than `depleted` of its words.
    """
    found = materialize(line_features(docs, host), "lines")
    above = frequent_lines(found, least_docs, share)
    key = ["doc_id", "text_key", "host"]
    lines = found.select(*key, F.explode("lines").alias("line")).select(*key, F.col("line.hash").alias("hash"), F.col("line.words").alias("words"))
    lost = join_on(lines, above, ["host", "hash"], "inner").distinct().groupBy(*key).agg(F.sum("words").alias("n_removed_words"), F.collect_set("hash").alias("removed_lines"))
    out = join_on(found.drop("lines"), lost, key, "left")
    removed = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    return out.withColumns(
        {
            "n_removed_words": removed,
            "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")),
        }
    ).withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_words") <= depleted * F.col("n_words")))


def without_lines(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for text, gone in zip(batch.column("text"), batch.column("__removed")):
        text, gone = text.as_py(), set(gone.as_py() or ())
        if gone and text is not None:
            keep = []
            for line in text.split("\n"):
                own = line.encode().translate(LINE_TABLE).split()
                if not own or np.array([xxhash.xxh3_64_intdigest(b" ".join(own))], np.uint64).view(np.int64)[0] not in gone:
                    keep.append(line)
            text = "\n".join(keep)
        out.append(text)
    at = batch.schema.get_field_index("text")
    return batch.set_column(at, "text", pa.array(out, pa.string()))


def apply_quality(docs: DataFrame, verdicts: DataFrame, host: str = "source", most_broadcast: int = 2_000_000) -> DataFrame:
    """The kept documents, frequent lines taken out of their texts (n_chars follows).

    Only documents with something to do are looked up. That list is broadcast if it has at most `most_broadcast` rows and
    its files are small (both measured first), and joined by shuffle beyond.
    """
    return sheltered(docs, lambda d: _applied(d, verdicts, host, most_broadcast), (*NAMED, host))


def _applied(docs: DataFrame, verdicts: DataFrame, host: str, most_broadcast: int) -> DataFrame:
    todo = verdicts.filter(~F.col("kept") | (F.col("n_removed_words") > 0)).select("doc_id", "text_key", F.col("host"), F.col("kept").alias("__kept"), F.when(F.col("kept"), F.col("removed_lines")).alias("__removed")).dropDuplicates(["doc_id", "text_key", "host"])
    todo = looked_up(todo, "quality-todo", most_broadcast)
    names = docs.columns
    keyed = docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__key": text_key(F.col("text")), "__host": F.col(host).cast("string")})
    todo = todo.withColumnsRenamed({"doc_id": "__r1", "text_key": "__r2", "host": "__r3"})
    met = keyed["__doc"].eqNullSafe(todo["__r1"]) & (keyed["__key"] == todo["__r2"]) & keyed["__host"].eqNullSafe(todo["__r3"])
    kept = keyed.join(todo, met, "left").filter(F.coalesce("__kept", F.lit(True))).select(*names, "__removed")
    cleaned = arrow_map(kept, without_lines, kept.schema).drop("__removed")
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else cleaned

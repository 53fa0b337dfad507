"""Alignment of two tokenizers over the same bytes.

Each text is encoded by a byte-level BPE (A, over a space and the text) and a sentencepiece model (B, over the text; the model
adds the space). Packed bitsets over the bytes mark where tokens of A and of B end; their AND has the shared cuts, popcounts
rank the cuts among the ends of either side, and so give the token ranges between two cuts: the groups. A link is a pair of an
A and a B token of one group; an id pair's count is the number of documents that hold it linked.

Pairs are counted in three steps, so no hot pair meets in one task and nothing is kept by document in the shuffle: documents
are written with their distinct pairs, in chunks of bounded text; a chunk's distinct pairs are summed over chunks; each chunk
gets the counts of its own pairs back and scores its documents.

A text is encoded in units, cut before a space that follows another byte than a space and precedes a printable ASCII
character: no token of either side reaches across. Whether that holds is asked of both tokenizers on probes when they are
read (and of B's vocabulary); else whole texts are encoded. Strings of special tokens are plain text.

Texts that are null, empty, or whose joined token bytes on either side differ from a space and the text (as with U+2581, which
B reads as a space) have no tokens: zeros, an empty digest. Rows that share a doc_id count each, a null doc_id stays null,
extra columns are ignored, an empty table gives an empty result. Memory grows with the longest text, and in a text with a run
of tokens that share no cut for long with the distinct pairs of that run.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD, batch_of, map_batches, materialize, slices
from .tokens import PROBES, Seen, digests_of

#: Bytes of text encoded at a time, and bytes of text of a chunk.
SLICE, CHUNK = 1 << 20, 8 << 20
#: Links of a group beyond which its pairs are counted by distinct ids.
WIDE = 1 << 14
#: Pairs summed in a worker before they are sent on.
PENDING = 1 << 21
LETTERS = re.compile(r" [A-Za-z]+")
SPACE_MARK = "▁"
MORE_PROBES = (*PROBES, "a  b   c    d", "x\n y\n\n z \n", "tab\t x", "l'été  où ", " lead", "  a  b  c", "!!! ??? ;; ((a)) 1 22 333", "trail  ", "a▁b c")
_pairs: dict[tuple[str, str], "Pair"] = {}
HELD.append(_pairs.clear)


def byte_alphabet() -> dict[str, int]:
    """The byte for each character that byte-level BPE writes it as: printable Latin-1 as itself, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers with the bytes of their tokens, and tables of units seen."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_size, self.b_size = self.a.get_vocab_size(), self.b.get_piece_size()
        letters, vocabulary = byte_alphabet(), self.a.get_vocab()
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, k in vocabulary.items():
            a_bytes[k] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.a_size = max(self.a_size, len(a_bytes))
        pieces = [self.b.id_to_piece(k) for k in range(self.b_size)]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE_MARK, " ").encode() for k, p in enumerate(pieces)]
        self.bytes = [pa.array(x, pa.binary()) for x in (a_bytes, b_bytes)]
        self.lengths = [pc.binary_length(x).to_numpy().astype(np.int64) for x in self.bytes]
        words = ["hello", "Zqxjkv", "antionhareble", "THE", "a"]
        self.plain_letters = all([t.id for t in self.a.model.tokenize("Ġ" + w)] == self.a.encode(f" {w}", add_special_tokens=False).ids for w in words)
        self.tables = [Seen(self.encode_a), Seen(self.encode_b)]
        self.by_unit = False
        if not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces):
            probes = pa.array(MORE_PROBES)
            whole = [x.tolist() for x in self.ids(probes)[0]]
            self.by_unit = True
            self.by_unit = whole == [x.tolist() for x in self.ids(probes)[0]]

    def encode_a(self, units: list[str]) -> list[list[int]]:
        ids: list[list[int] | None] = [None] * len(units)
        rest, model = [], self.a.model
        for k, u in enumerate(units):
            if self.plain_letters and LETTERS.fullmatch(u):
                ids[k] = [t.id for t in model.tokenize("Ġ" + u[1:])]
            else:
                rest.append(k)
        run = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        for at in range(0, len(rest), 10_000):
            part = rest[at : at + 10_000]
            for k, e in zip(part, run([units[k] for k in part], add_special_tokens=False)):
                ids[k] = e.ids
        return ids

    def encode_b(self, units: list[str]) -> list[list[int]]:
        return self.b.encode([u[1:] for u in units], num_threads=1)

    def units(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where units start in texts that lie one after the other, each with its space before."""
        if not self.by_unit or len(raw) < 3:
            return offsets[:-1]
        inner = (raw[1:-1] == 0x20) & (raw[:-2] != 0x20) & (raw[2:] > 0x20) & (raw[2:] < 0x7F)
        inner = np.flatnonzero(inner) + 1
        return np.union1d(inner, offsets[:-1])

    def ids(self, texts: pa.Array):
        """Ids of each side, flat, and the offsets of texts in them; the texts' bytes, each with its space, and their offsets."""
        spaced = pc.binary_join_element_wise(" ", texts, "").cast(pa.large_binary())
        _, where, data = spaced.buffers()
        offsets = np.frombuffer(where, np.int64)[: len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        starts = self.units(raw, offsets)
        each = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(raw))
        coded = each.cast(pa.string()).dictionary_encode()
        at, first = coded.indices, np.searchsorted(starts, offsets)
        digests = digests_of(coded.dictionary.to_numpy(zero_copy_only=False))
        flat, bounds = [], []
        for seen in self.tables:
            table, sizes = seen.table(coded.dictionary, digests)
            flat.append(table.take(at).flatten().to_numpy().astype(np.int64))
            bounds.append(np.concatenate([[0], np.cumsum(sizes[at.to_numpy()])])[first])
        return flat, bounds, raw, offsets

    @cached_property
    def numbers(self) -> pa.Array:
        """Decimal ids before each of the marks that may follow them."""
        return pa.array([f"{k}{mark}" for mark in ",|;" for k in range(max(self.a_size, self.b_size))])


def pair(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Pair(a_path, b_path)
    return _pairs[a_path, b_path]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... of sizes[k] numbers each."""
    stops = np.cumsum(sizes)
    return np.arange(stops[-1] if len(stops) else 0) - np.repeat(stops - sizes - starts, sizes)


class Aligned:
    """The groups of a slice of texts."""

    def __init__(self, both: Pair, texts: pa.Array):
        self.both, n = both, len(texts)
        flat, bounds, raw, offsets = both.ids(pc.fill_null(texts, ""))
        long = np.diff(offsets)
        good, source = long > 1, raw.tobytes()
        for side in range(2):
            ends = np.concatenate([[0], np.cumsum(both.lengths[side][flat[side]])])[bounds[side]]
            good &= np.diff(ends) == long
            joined = both.bytes[side].take(pa.array(flat[side]))
            data = joined.buffers()[2]
            data = b"" if data is None else data.to_pybytes()
            for k in np.flatnonzero(good).tolist():
                if data[ends[k] : ends[k + 1]] != source[offsets[k] : offsets[k + 1]]:
                    good[k] = False
        self.good, sizes = good, [np.where(good, np.diff(b), 0) for b in bounds]
        self.ids = [f[ranges(b[:-1], s)] for f, b, s in zip(flat, bounds, sizes)]
        self.first = [np.concatenate([[0], np.cumsum(s)]) for s in sizes]  # each text's first token, by side
        self.bytes = np.concatenate([[0], np.cumsum(np.where(good, long, 0))])
        self.n_tokens = sizes
        words = []
        for side in range(2):
            marks = np.zeros(-(-int(self.bytes[-1]) // 64) * 64, bool)
            marks[np.cumsum(both.lengths[side][self.ids[side]]) - 1] = True
            words.append(np.packbits(marks, bitorder="little").view("<u8"))
        shared = words[0] & words[1]
        self.cuts = np.flatnonzero(np.unpackbits(shared.view(np.uint8), bitorder="little"))  # the last byte before each
        word, upto = self.cuts >> 6, ~np.uint64(0) >> (63 - self.cuts & 63).astype(np.uint64)
        self.ends = []  # of groups, among the tokens of each side
        for side in words:
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(side).astype(np.int64))])
            self.ends.append(before[word] + np.bitwise_count(side[word] & upto))
        self.starts = [np.concatenate([[0], e[:-1]]) if len(e) else e for e in self.ends]
        self.sizes = [e - s for e, s in zip(self.ends, self.starts)]
        self.group_doc = np.searchsorted(self.bytes, self.cuts, side="right") - 1
        self.group_first = np.searchsorted(self.cuts, self.bytes)  # each text's first group
        self.n_groups = np.diff(self.group_first)
        self.n_links = np.diff(np.concatenate([[0], np.cumsum(self.sizes[0] * self.sizes[1])])[self.group_first])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's distinct linked pairs in order, as a * size of B + b: their number by text, the pairs, how often each is linked."""
        (p, q), (a, b), (a0, b0), size = self.sizes, self.ids, self.starts, self.both.b_size
        links = p * q
        small = np.flatnonzero(links <= WIDE)
        group = np.repeat(small, links[small])
        inside, wide = ranges(np.zeros(len(small), np.int64), links[small]), q[group]
        row = inside // np.maximum(wide, 1)
        key = a[a0[group] + row] * size + b[b0[group] + inside - row * wide]
        docs = self.group_doc[group]
        order = np.lexsort((key, docs)) if self.both.a_size * size >= 1 << 43 or len(self.good) >= 1 << 20 else None
        if order is None:
            both = np.sort(docs.astype(np.uint64) << np.uint64(43) | key.astype(np.uint64))
            docs, key = (both >> np.uint64(43)).astype(np.int64), (both & np.uint64((1 << 43) - 1)).astype(np.int64)
        else:
            docs, key = docs[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (key[1:] != key[:-1])
        at = np.flatnonzero(new)
        docs, key, times = docs[at], key[at], np.diff(np.append(at, len(new)))
        for g in np.flatnonzero(links > WIDE).tolist():
            (ua, ca), (ub, cb) = (np.unique(x[lo:hi], return_counts=True) for x, lo, hi in ((a, a0[g], self.ends[0][g]), (b, b0[g], self.ends[1][g])))
            docs = np.concatenate([docs, np.full(len(ua) * len(ub), self.group_doc[g])])
            key = np.concatenate([key, (ua[:, None] * size + ub).ravel()])
            times = np.concatenate([times, (ca[:, None] * cb).ravel()])
        if len(at) != len(key):
            order = np.lexsort((key, docs))
            docs, key, times = docs[order], key[order], times[order]
            at = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (key[1:] != key[:-1])]))
            docs, key, times = docs[at], key[at], np.add.reduceat(times, at)
        return np.bincount(docs, minlength=len(self.good)), key, times

    def digests(self) -> list[str]:
        """sha256 of `a1,a2|b1;...` of each text, '' for one without tokens."""
        (p, q), many = self.sizes, len(self.both.numbers) // 3
        before = np.cumsum(p + q) - p - q
        codes = np.empty(len(self.ids[0]) + len(self.ids[1]), np.int64)
        codes[ranges(before, p)] = self.ids[0]
        codes[ranges(before + p, q)] = self.ids[1]
        codes[before + p - 1] += many
        codes[before + p + q - 1] += 2 * many
        text = self.both.numbers.take(pa.array(codes))
        _, where, data = text.buffers()
        at = np.frombuffer(where, np.int32)[self.first[0] + self.first[1]].tolist()
        view = memoryview(data) if data is not None else memoryview(b"")
        return [hashlib.sha256(view[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(at[:-1], at[1:])]


def squeezed(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def opened(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind).astype(np.int64)


LINKS = "chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"


def linker(a_path: str, b_path: str):
    def run(batches):
        both, chunk, room = pair(a_path, b_path), TaskContext.get().partitionId() << 24, CHUNK
        for batch in slices(batches, "text", SLICE):
            texts = batch.column("text")
            found = Aligned(both, texts)
            sizes, key, times = found.pairs()
            stops = np.cumsum(sizes)
            pairs = [squeezed(np.diff(key[e - n : e], prepend=0), "<u8") for e, n in zip(stops.tolist(), sizes.tolist())]
            often = [squeezed(times[e - n : e], "<u4") for e, n in zip(stops.tolist(), sizes.tolist())]
            columns = [np.full(len(texts), chunk), batch.column("doc_id"), *found.n_tokens, found.n_groups, found.n_links, found.digests()]
            yield batch_of(["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"], [*columns, pa.array(pairs, pa.binary()), pa.array(often, pa.binary())])
            room -= int(found.bytes[-1])
            if room <= 0:
                chunk, room = chunk + 1, CHUNK

    run.keeps_tables = True
    return run


def links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The written table of documents with their distinct pairs (differences of a * size of B + b, compressed) and how often each is linked."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialize(map_batches(narrow, linker(a_path, b_path), LINKS), "links")


def summed(batches):
    """(chunk, pair, docs) of each chunk's distinct pairs; a chunk that is read in two parts has two rows for a pair."""

    def sent(chunk, held):
        pairs, docs = np.unique(np.concatenate(held), return_counts=True)
        return batch_of(["chunk", "pair", "docs"], [np.full(len(pairs), chunk), pairs, docs])

    at, held, size = None, [], 0
    for batch in batches:
        for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("pairs").to_pylist()):
            if held and (chunk != at or size > PENDING):
                yield sent(at, held)
                held, size = [], 0
            at = chunk
            held.append(np.cumsum(opened(data, "<u8")))
            size += len(held[-1])
    if held:
        yield sent(at, held)


def b_size(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def scored(by_chunk: DataFrame, size: int) -> DataFrame:
    """(pair, docs, best): the documents of each pair, and whether no other pair of its A id has more. An A id has at most as
    many pairs as B has ids, and is summed over chunks before."""
    counts = by_chunk.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.expr(f"pair div {size}"))
    highest = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(highest, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def looked_up_in(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk's documents with what the counts of its pairs come to."""
    known, at = np.unique(right.column("pair").to_numpy(), return_index=True)
    docs, best = right.column("docs").to_numpy()[at], right.column("best").to_numpy(zero_copy_only=False).astype(np.int64)[at]
    n_best, total = [], []
    for pairs, times in zip(left.column("pairs").to_pylist(), left.column("times").to_pylist()):
        place, often = np.searchsorted(known, np.cumsum(opened(pairs, "<u8"))), opened(times, "<u4")
        n_best.append(int((often * best[place]).sum()) if len(place) else 0)
        total.append(int((often * docs[place]).sum()) if len(place) else 0)
    kept = [left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*kept, pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), left.column("groups_sha256")], names=[c.split()[0] for c in RESULT.split(", ")])


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document: tokens of either side, groups, links, links that are best for their A id, the sum of the links'
    counts, and the digest of its groups."""
    written = links(docs, a_path, b_path)
    by_chunk = materialize(map_batches(written.select("chunk", "pairs"), summed, "chunk bigint, pair bigint, docs bigint"), "chunk-pairs")
    met = by_chunk.select("chunk", "pair").join(scored(by_chunk, b_size(b_path)), "pair")
    return written.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(looked_up_in, RESULT)


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a_id, b_id, docs, best): in how many documents each id pair is linked, and whether that is the most of its A id."""
    written, size = links(docs, a_path, b_path), b_size(b_path)
    by_chunk = map_batches(written.select("chunk", "pairs"), summed, "chunk bigint, pair bigint, docs bigint")
    return scored(by_chunk, size).select(F.expr(f"pair div {size}").alias("a_id"), (F.col("pair") % size).alias("b_id"), "docs", "best")


def token_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, stops, a_stops, b_stops, a_ids, b_ids): for each document where its groups end, in bytes of a space and the text
    and in tokens of either side, and the ids. Documents without tokens have empty lists."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        both = pair(a_path, b_path)
        for batch in slices(batches, "text", SLICE):
            found = Aligned(both, batch.column("text"))
            doc = found.group_doc
            groups = [found.cuts + 1 - found.bytes[doc], *(e - f[doc] for e, f in zip(found.ends, found.first))]
            lists = [pa.ListArray.from_arrays(pa.array(found.group_first.astype(np.int32)), pa.array(g)) for g in groups]
            lists += [pa.ListArray.from_arrays(pa.array(f.astype(np.int32)), pa.array(i)) for f, i in zip(found.first, found.ids)]
            yield batch_of(["doc_id", "stops", "a_stops", "b_stops", "a_ids", "b_ids"], [batch.column("doc_id"), *lists])

    run.keeps_tables = True
    return map_batches(narrow, run, "doc_id bigint, stops array<bigint>, a_stops array<bigint>, b_stops array<bigint>, a_ids array<bigint>, b_ids array<bigint>")

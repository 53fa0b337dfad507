"""Substring deduplication with prefix-partitioned suffix trees over words.

A suffix is the word sequence from one position on, as deep as a window is long. A word is removed if a window over it also
starts in a document with a smaller doc_id.

1. Documents with equal texts are one class; all but its smallest doc_id repeat it whole.
2. A window's anchor is the run of `RUN` words in it with the least fingerprint. Equal windows have equal anchors at the same
   place, so only suffixes that start at anchors (about a fifth of all positions) need to be in a tree, with the words before
   them that the anchor's windows reach. Anchors are dealt out by value, after those that a slice of texts shares among itself
   have been summed up; those of several texts are returned to their texts.
3. The suffixes at these anchors are counted by first word; prefixes with more suffixes than a task should hold are made
   longer, word by word. Groups with a common prefix are dealt to buckets of bounded size. Where a whole anchor is still too
   frequent, its windows are suffixes of their own with themselves as prefix; a window that is too frequent even so needs no
   tree, only its smallest doc_id, which is summed on the map side and looked up.
4. In a bucket, suffixes in lexicographic order with their common-prefix lengths are the subtrees of its prefixes (`Subtree`).
   Suffixes are as deep as their anchor's windows reach. Internal nodes as deep as a window are the repeats; each one's smallest
   doc_id tells which of its leaves are removed. `maximal_repeats` follows the subtrees of windows that are preceded by different
   words to their full depth.

Nulls: a null text has no words; a null doc_id counts as larger than all others. Repeated rows (same doc_id and text) are one
document and each get a result row. Texts shorter than a window lose nothing. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, SLICE_BYTES, arrow_map, batch_of, blobs, bucket_of, buckets_for, by_bucket, distinct_texts, looked_up, map_batches, materialize, mix, small_enough, window_hashes, with_keys, Words

#: Words in a run from which anchors are taken.
RUN = 6
#: Suffixes of a prefix, and of a bucket, that a task should hold.
GROUP = 120_000
#: Buckets at least, so that small inputs are spread as well.
LEAST_BUCKETS = 24
LAST = (1 << 63) - 1
#: Stands where a text has ended.
END = np.uint64((1 << 64) - 1)


def anchors(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text; their anchors' fingerprints and places."""
    n, run = len(hashes) - width + 1, min(RUN, width)
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    runs = window_hashes(hashes, run)
    least, at = runs[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, width - run + 1):
        lower = runs[k : k + n] < least
        least[lower], at[lower] = runs[k : k + n][lower], k
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return inside, least[inside], inside + at[inside]


ANCHORS = "bucket int, told boolean, anchors binary, text_keys binary, sure binary"


def anchor_rows(width: int, buckets: int):
    """Each text's anchors, by bucket. Anchors that several texts of a slice have are known to be shared: these texts are told at
    once, and the slice sends each such anchor once, marked as sure; so an anchor that a third of all texts have costs its
    bucket a row for each slice, not for each text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"))
        start, value, _ = anchors(words.hashes(), words.offsets, width)
        doc = np.searchsorted(words.offsets, start, side="right") - 1
        order = np.lexsort((doc, value))
        value, doc = value[order], doc[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        value, doc = value[new], doc[new]
        key = batch.column("text_key").to_numpy()[doc]
        same = value[1:] == value[:-1]
        first = np.concatenate([[True], ~same]) if len(value) else np.zeros(0, bool)
        several = np.zeros(len(value), bool)
        several[1:] |= same
        several[:-1] |= same
        bucket, (v, k, s) = blobs(bucket_of(mix(value[first]), buckets), value[first], key[first], several[first])
        to, (told, whom) = blobs(bucket_of(mix(key[several].view(np.uint64)), buckets), value[several], key[several])
        return batch_of(
            ["bucket", "told", "anchors", "text_keys", "sure"],
            [pa.array(np.concatenate([bucket, to]).astype(np.int32)), pa.array([False] * len(bucket) + [True] * len(to)), pa.array([*v, *told], pa.binary()), pa.array([*k, *whom], pa.binary()), pa.array([*s, *[b""] * len(to)], pa.binary())],
        )

    return run


def by_text(v: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(k, kind="stable")
    keys, starts = np.unique(k[order], return_index=True)
    return batch_of(["text_key", "shared"], [keys, pa.array([x.tobytes() for x in np.split(v[order], starts[1:])], pa.binary())])


def shared_anchors(batches):
    """By text: its anchors that other texts have too."""
    told: list[tuple[bytes, bytes]] = []

    def asked():
        for b in batches:
            known = b.column("told").to_numpy(zero_copy_only=False)
            if known.any():
                at = pa.array(np.flatnonzero(known))
                told.extend(zip(b.column("anchors").take(at).to_pylist(), b.column("text_keys").take(at).to_pylist()))
            if not known.all():
                yield b.filter(pa.array(~known))

    def passed():
        while told:
            v, k = told.pop()
            yield by_text(np.frombuffer(v, np.uint64), np.frombuffer(k, np.int64))

    for _, (v, k, s) in by_bucket(asked(), ["anchors", "text_keys", "sure"]):
        yield from passed()
        v, k, s = np.frombuffer(v, np.uint64), np.frombuffer(k, np.int64), np.frombuffer(s, bool)
        order = np.argsort(v, kind="stable")
        v, k, s = v[order], k[order], s[order]
        same = v[1:] == v[:-1]
        several = np.zeros(len(v), bool)
        several[1:] |= same
        several[:-1] |= same
        if (news := several & ~s).any():  # what is sure was told already
            yield by_text(v[news], k[news])
    yield from passed()


NAMES = ["table", "words", "docs", "text_keys", "places", "lows", "highs"]
SUFFIXES = ", ".join(f"{n} binary" for n in NAMES)
DEALT = "bucket int, " + SUFFIXES


class Suffixes:
    """Suffixes at anchors. A row of words holds `reach` words before the anchor and a window from it on, and one word more on either
    side (0: not known, or before the text); the anchor's windows start low to high words before it; place is the anchor's position
    in its text."""

    def __init__(self, words, docs, text_keys, places, lows, highs):
        self.words, self.docs, self.text_keys, self.places, self.lows, self.highs = words, docs, text_keys, places, lows, highs

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, at) -> Suffixes:
        return Suffixes(*(x[at] for x in (self.words, self.docs, self.text_keys, self.places, self.lows, self.highs)))

    @staticmethod
    def joined(parts: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate([getattr(p, n) for p in parts]) for n in ("words", "docs", "text_keys", "places", "lows", "highs")))

    def coded(self) -> list[bytes]:
        """Compressed columns, with a table of distinct words."""
        table, at = np.unique(self.words, return_inverse=True)
        at = at.reshape(self.words.shape).astype(np.uint16 if len(table) < 65536 else np.uint32).T
        squeeze = zstandard.ZstdCompressor(level=1)
        columns = (table, at, self.docs, self.text_keys, self.places.astype(np.int32), self.lows.astype(np.uint8), self.highs.astype(np.uint8))
        return [squeeze.compress(np.ascontiguousarray(c).tobytes()) for c in columns]

    @staticmethod
    def decoded(row: list[bytes]) -> Suffixes:
        opened = [zstandard.ZstdDecompressor().decompress(x) for x in row]
        table, docs, keys, places, lows, highs = (np.frombuffer(opened[i], k) for i, k in ((0, np.uint64), (2, np.int64), (3, np.int64), (4, np.int32), (5, np.uint8), (6, np.uint8)))
        at = np.frombuffer(opened[1], np.uint16 if len(table) < 65536 else np.uint32)
        return Suffixes(table[at].reshape(-1, len(docs)).T, docs, keys, places, lows.astype(np.int64), highs.astype(np.int64))

    def reach(self, width: int) -> int:
        return self.words.shape[1] - width - 2

    def at(self, width: int, back: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The suffixes that start so many words before the anchor: which rows have one, their words, how many are known, and the
        word before (0: the text begins there)."""
        own = np.flatnonzero((self.lows <= back) & (back <= self.highs))
        first = self.reach(width) + 1 - back
        words = self.words[own, first:]
        return own, words, ((words != 0) & (words != END)).sum(axis=1), self.words[own, first - 1]

    def as_windows(self, width: int) -> Suffixes:
        """Each window as a suffix of its own."""
        reach, parts = self.reach(width), []
        for back in range(reach + 1):
            own, words, _, left = self.at(width, back)
            wide = np.concatenate([np.zeros((len(own), reach), np.uint64), left[:, None], words[:, : width + 1]], axis=1)
            none = np.zeros(len(own), np.int64)
            parts.append(Suffixes(wide, self.docs[own], self.text_keys[own], self.places[own] - np.int32(back), none, none))
        return Suffixes.joined(parts)


def rows_of(batches, names: list[str]):
    """(first columns, suffixes) row by row."""
    for b in batches:
        for row in zip(*(b.column(n).to_pylist() for n in (*names, *NAMES))):
            yield (*row[: len(names)], Suffixes.decoded(row[len(names) :]))


def suffix_rows(width: int):
    """Of each text the suffixes at anchors that other texts have too."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        words = Words(batch.column("text"))
        hashes = words.hashes()
        start, value, place = anchors(hashes, words.offsets, width)
        shared = [np.frombuffer(b"".join(x.as_py()), np.uint64) for x in batch.column("shared")]
        if not len(start) or not sum(map(len, shared)):
            return None
        doc = np.searchsorted(words.offsets, start, side="right") - 1
        spread = lambda v, d: mix(v ^ mix(d.astype(np.uint64) + np.uint64(1)))  # noqa: E731  one number for value and text; a clash only adds a suffix
        wanted = np.sort(spread(np.concatenate(shared), np.repeat(np.arange(len(shared)), [len(x) for x in shared])))
        own = spread(value, doc)
        use = wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own
        start, place, doc = start[use], place[use], doc[use]
        if not len(start):
            return None
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        at, doc = place[first], doc[first]
        highs, lows = at - start[first], at - start[last]
        reach = width - min(RUN, width)
        offset = np.arange(-reach - 1, width + 1)
        spot = at[:, None] + offset
        known = (offset >= -highs[:, None] - 1) & (offset <= width - lows[:, None]) & (spot >= words.offsets[doc][:, None])
        matrix = np.where(known, np.where(spot < words.offsets[doc + 1][:, None], hashes[np.clip(spot, 0, len(hashes) - 1)], END), np.uint64(0))
        ids, keys = batch.column("id").to_numpy()[doc], batch.column("text_key").to_numpy()[doc]
        row = Suffixes(matrix, ids, keys, at - words.offsets[doc], lows, highs).coded()
        return batch_of(NAMES, [pa.array([x], pa.binary()) for x in row])

    return run


def prefix(matrix: np.ndarray, length: int) -> np.ndarray:
    """A number for the first words of each row."""
    total = np.full(len(matrix), np.uint64(length))
    for k in range(length):
        total = mix(total ^ matrix[:, k])
    return total


def lengths_of(runs: np.ndarray, large: dict[int, np.ndarray]) -> np.ndarray:
    """How many words make each suffix's prefix; one more than an anchor has if that is still too frequent."""
    length, todo = np.ones(len(runs), np.int64), np.arange(len(runs))
    for k in range(1, runs.shape[1] + 1):
        if k not in large or not len(todo):
            break
        todo = todo[np.isin(prefix(runs[todo], k), large[k])]
        length[todo] = k + 1
    return length


def anchors_of(s: Suffixes, width: int) -> np.ndarray:
    first = s.reach(width) + 1
    return s.words[:, first : first + min(RUN, width)]


def counter(width: int, length: int, large: dict[int, np.ndarray]):
    """Counts of prefixes of a length among suffixes whose shorter prefixes are all too large."""

    def run(batches):
        for (s,) in rows_of(batches, []):
            runs = anchors_of(s, width)
            runs = runs[lengths_of(runs, large) == length]
            value, count = np.unique(prefix(runs, length), return_counts=True)
            yield batch_of(["prefix", "suffixes"], [value.view(np.int64), count.astype(np.int64)])

    return run


def frequent(width: int, large: dict[int, np.ndarray]):
    """Of windows of too frequent anchors: how many, and the smallest doc_id, by batch."""

    def run(batches):
        for (s,) in rows_of(batches, []):
            w = s[lengths_of(anchors_of(s, width), large) > min(RUN, width)].as_windows(width)
            value, at, count = np.unique(prefix(w.words[:, -width - 1 : -1], width), return_inverse=True, return_counts=True)
            least = np.full(len(value), LAST)
            np.minimum.at(least, at, w.docs)
            yield batch_of(["window", "n", "least"], [value.view(np.int64), count.astype(np.int64), least])

    return run


def dealer(width: int, large: dict[int, np.ndarray], hot: tuple[np.ndarray, np.ndarray], buckets: int):
    """Suffixes by bucket of their prefix. Removed places of too frequent windows come out in buckets below 0, ready."""

    def dealt(s: Suffixes, key: np.ndarray):
        bucket = bucket_of(key, buckets)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
            yield (k, *s[order[bounds[k] : bounds[k + 1]]].coded())

    def out(s: Suffixes):
        runs = anchors_of(s, width)
        length = lengths_of(runs, large)
        key = np.zeros(len(s), np.uint64)
        for k in range(1, runs.shape[1] + 1):
            at = length == k
            key[at] = prefix(runs[at], k)
        often = length > runs.shape[1]
        yield from dealt(s[~often], key[~often])
        if often.any():
            w = s[often].as_windows(width)
            key = prefix(w.words[:, -width - 1 : -1], width)
            at = np.minimum(np.searchsorted(hot[0], key), max(0, len(hot[0]) - 1))
            ready = hot[0][at] == key if len(hot[0]) else np.zeros(len(key), bool)
            gone = w[ready][w.docs[ready] > hot[1][at[ready]]] if ready.any() else w[:0]
            if len(gone):
                yield (-1 - int(gone.places[0]) % buckets, *gone.coded())
            yield from dealt(w[~ready], key[~ready])

    def run(batches):
        held: list[Suffixes] = []
        kinds = [pa.int32(), *[pa.binary()] * len(NAMES)]

        def batch():
            rows = list(out(Suffixes.joined(held)))
            held.clear()
            return batch_of(["bucket", *NAMES], [pa.array(c, t) for c, t in zip(zip(*rows), kinds)])

        for (s,) in rows_of(batches, []):
            held.append(s)
            if sum(map(len, held)) >= 100_000:
                yield batch()
        if sum(map(len, held)):
            yield batch()

    return run


def lexicographic(matrix: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Order of rows by words, then document."""
    table, rank = np.unique(matrix, return_inverse=True)
    rank = rank.reshape(matrix.shape).astype(np.uint64)
    bits = max(1, int(len(table)).bit_length())
    keys = []
    for low in range(0, matrix.shape[1], 64 // bits):
        key = np.zeros(len(matrix), np.uint64)
        for c in range(low, min(low + 64 // bits, matrix.shape[1])):
            key = (key << np.uint64(bits)) | rank[:, c]
        keys.append(key)
    return np.lexsort((docs, *keys[::-1]))


class Subtree:
    """The suffix tree of a group of suffixes: its leaves in lexicographic order, with the lengths of the prefixes that neighbours
    have in common. Runs of leaves between which those reach a depth are the tree's internal nodes (its LCP intervals)."""

    def __init__(self, matrix: np.ndarray, known: np.ndarray, docs: np.ndarray):
        self.order, self.docs = lexicographic(matrix, docs), docs
        rows, known = matrix[self.order], known[self.order]
        differs = rows[1:] != rows[:-1]
        common = np.where(differs.any(axis=1), differs.argmax(axis=1), matrix.shape[1]) if len(rows) else np.zeros(0, np.int64)
        self.common = np.minimum(common, np.minimum(known[1:], known[:-1]))

    def repeated(self, depth: int) -> np.ndarray:
        """Which leaves lie below an internal node of at least this depth that has a leaf of a smaller doc_id."""
        gone = np.zeros(len(self.docs), bool)
        if len(gone) > 1:
            top = np.concatenate([[True], self.common < depth])
            node, docs = np.cumsum(top) - 1, self.docs[self.order]
            gone[self.order] = docs > np.minimum.reduceat(docs, np.flatnonzero(top))[node]
        return gone

    def internal(self, depth: int):
        """(first leaf, last leaf, depth) of each internal node of at least this depth, children before parents."""
        open_: list[tuple[int, int]] = []  # first leaf and depth of the nodes on the way down to the leaf before
        for leaf, common in enumerate([*self.common.tolist(), -1], 1):
            first = leaf - 1
            while open_ and open_[-1][1] > common:
                first, own = open_.pop()
                yield first, leaf - 1, own
            if common >= depth and (not open_ or open_[-1][1] < common):
                open_.append((first, common))


REPEATS = "words int, places bigint, documents bigint, doc_id bigint, start int"
#: A place at which a class of equal word sequences (all of `depth` words, told by a fingerprint) stands, with the word before it.
LEAVES = "cls bigint, depth int, id bigint, text_key bigint, start int, left bigint"
BLOCKS = LEAVES + ", block binary"
#: Words by which classes are read on: in the first round, at most, and of classes too large for a task.
FIRST, MOST, FEW = 64, 4096, 16
#: Words of a class that a tree holds at a time.
CELLS = 16_000_000


def runs_of(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) of each run of rows, from which rows are like the one before them."""
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    return first, np.append(first[1:], len(same) + 1)


def spread_left(left: np.ndarray) -> bool:
    """Whether a sequence can't be extended to the left at all its places: other words before it, or a text's beginning."""
    return bool((left == 0).any() or (left != left[0]).any())


def leaf_rows(cls, depth, docs, keys, starts, left) -> pa.RecordBatch:
    signed = lambda x: np.ascontiguousarray(x).view(np.int64)
    return batch_of([c.split()[0] for c in LEAVES.split(", ")], [signed(cls), np.full(len(cls), depth, np.int32), docs, keys, starts.astype(np.int32), signed(left)])


def window_leaves(width: int):
    """The places of windows that stand in several texts and not always after the same word, from the trees of the buckets."""

    def told(s: Suffixes):
        for back in range(s.reach(width) + 1):
            own, matrix, known, left = s.at(width, back)
            if len(own) < 2:
                continue
            tree = Subtree(matrix, known, s.docs[own])
            first, last = runs_of(tree.common >= width)
            docs, before = s.docs[own][tree.order], left[tree.order]
            several = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
            spread = (np.minimum.reduceat(before, first) == 0) | (np.minimum.reduceat(before, first) != np.maximum.reduceat(before, first))
            at = np.repeat(several & spread, last - first)
            if at.any():
                rows = own[tree.order][at]
                yield leaf_rows(prefix(matrix[tree.order][at], width), width, docs[at], s.text_keys[rows], s.places[rows] - np.int32(back), before[at])

    def run(batches):
        at, held = None, []
        for bucket, s in rows_of(batches, ["bucket"]):
            if bucket != at:
                if held:
                    yield from told(Suffixes.joined(held))
                at, held = bucket, []
            if bucket >= 0:
                held.append(s)
        if held:
            yield from told(Suffixes.joined(held))

    return run


def frequent_leaves(width: int, large: dict[int, np.ndarray], hot: np.ndarray):
    """The places of windows too frequent for a bucket."""

    def run(batches):
        for (s,) in rows_of(batches, []):
            w = s[lengths_of(anchors_of(s, width), large) > min(RUN, width)].as_windows(width)
            cls = prefix(w.words[:, -width - 1 : -1], width)
            at = np.isin(cls, hot)
            if at.any():
                yield leaf_rows(cls[at], width, w.docs[at], w.text_keys[at], w.places[at], w.words[at, -width - 2])

    return run


def block_rows(size: int):
    """For each text's leaves the hashes of the words that follow, END where the text has ended."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        words = Words(batch.column("text"))
        hashes, leaves = words.hashes(), batch.column("leaves")
        count = np.diff(leaves.offsets.to_numpy())
        flat = leaves.flatten()
        if not len(flat):
            return None
        cls, depth, start, left = (flat.field(n).to_numpy() for n in ("cls", "depth", "start", "left"))
        doc = np.repeat(np.arange(len(count)), count)
        spot = (words.offsets[doc] + start + depth)[:, None] + np.arange(size)
        matrix = np.where(spot < words.offsets[doc + 1][:, None], hashes[np.clip(spot, 0, len(hashes) - 1)], END)
        ids, keys = batch.column("id").to_numpy()[doc], batch.column("text_key").to_numpy()[doc]
        return batch_of([c.split()[0] for c in BLOCKS.split(", ")], [cls, depth, ids, keys, start, left, pa.array([x.tobytes() for x in matrix], pa.binary())])

    return run


FOUND = REPEATS + ", " + ", ".join(f"next_{c}" for c in LEAVES.split(", "))


def found_rows(repeats: list[tuple], leaves: list[tuple]):
    """Repeats, and leaves of classes to be read on, as rows of one table."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in FOUND.split(", ")]
    for rows, own, filled in ((repeats, kinds[0], range(5)), (leaves, kinds[1], range(5, 11))):
        if rows:
            columns = dict(zip(filled, (pa.array(c, t) for c, t in zip(zip(*rows), own))))
            yield batch_of(names, [columns.get(k, pa.nulls(len(rows), (kinds[0] + kinds[1])[k])) for k in range(11)])


def subtrees(batches):
    """The maximal repeats among classes of leaves with their next words, and the leaves that agree on all of these.

    A class is a subtree whose root is as deep as the class; an internal node is right-maximal, as its children begin with other words
    or a text ends there. It is told if it has leaves of several documents and isn't always preceded by the same word; a node that
    is, and all below it, can be extended to the left.
    """

    def told(depth, docs, keys, starts, left, blocks):
        matrix = np.stack([np.frombuffer(b, np.uint64) for b in blocks])
        matrix = matrix[:, : max(FEW, CELLS // len(matrix))]
        size, repeats, leaves = matrix.shape[1], [], []
        tree = Subtree(matrix, (matrix != END).sum(axis=1), docs)
        for first, last, below in tree.internal(0):
            at = tree.order[first : last + 1]
            if docs[at].min() == docs[at].max() or not spread_left(left[at]):
                continue
            if below < size:
                one = at[np.lexsort((starts[at], docs[at]))[0]]
                repeats.append((depth + below, len(at), len(np.unique(docs[at])), int(docs[one]), int(starts[one])))
            else:
                deeper = int(mix(np.array([cls_at], np.int64).view(np.uint64) ^ prefix(matrix[at[:1]], size)).view(np.int64)[0])
                leaves += [(deeper, depth + size, *x) for x in zip(docs[at].tolist(), keys[at].tolist(), starts[at].tolist(), left[at].view(np.int64).tolist())]
        return found_rows(repeats, leaves)

    cls_at, held = None, []

    def closed():
        columns = list(zip(*held))
        docs, keys, starts = (np.array(columns[k], np.int64) for k in (1, 2, 3))
        return told(columns[0][0], docs, keys, starts, np.array(columns[4], np.int64).view(np.uint64), columns[5])

    for batch in batches:
        for cls, *row in zip(*(batch.column(c.split()[0]).to_pylist() for c in BLOCKS.split(", "))):
            if cls != cls_at:
                if len(held) > 1:
                    yield from closed()
                cls_at, held = cls, []
            held.append(row)
    if len(held) > 1:
        yield from closed()


PREFIXES = "cls bigint, depth int, prefix bigint, id bigint, text_key bigint, start int, left bigint, after bigint"


def prefix_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of each leaf of a class too large for a task, the prefixes of its next words and the word after each (0: the text ends)."""
    matrix = np.stack([np.frombuffer(b, np.uint64) for b in batch.column("block").to_pylist()])
    known, size = (matrix != END).sum(axis=1), matrix.shape[1]
    total, out = batch.column("cls").to_numpy().view(np.uint64), []
    for k in range(size):
        at = np.flatnonzero(known >= k)
        if not len(at):
            break
        rows = batch.take(pa.array(at))
        after = np.where(known[at] > k, matrix[at, k], np.uint64(0))
        depth = rows.column("depth").to_numpy() + k
        out.append(batch_of([c.split()[0] for c in PREFIXES.split(", ")], [rows.column("cls"), depth.astype(np.int32), total[at].view(np.int64), *(rows.column(c) for c in ("id", "text_key", "start", "left")), after.view(np.int64)]))
        total = mix(total ^ matrix[:, k])
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0]


def next_leaves(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The leaves of such a class by their next words: classes `FEW` words deeper."""
    matrix = np.stack([np.frombuffer(b, np.uint64) for b in batch.column("block").to_pylist()])
    whole = (matrix != END).all(axis=1)
    rows, matrix = batch.filter(pa.array(whole)), matrix[whole]
    total = rows.column("cls").to_numpy().view(np.uint64)
    for k in range(matrix.shape[1]):
        total = mix(total ^ matrix[:, k])
    kept = [rows.column(c) for c in ("id", "text_key", "start", "left")]
    return batch_of([c.split()[0] for c in LEAVES.split(", ")], [total.view(np.int64), (rows.column("depth").to_numpy() + matrix.shape[1]).astype(np.int32), *kept])


def by_prefix(blocks: DataFrame) -> DataFrame:
    """The maximal repeats of classes too large for a task, `FEW` words on: prefixes are counted, summed on the map side, and
    distinct documents by a sum over (prefix, document), so no task holds a class."""
    rows = arrow_map(blocks, prefix_rows, PREFIXES, "block")
    key = ["cls", "depth", "prefix"]
    ends = [F.count("*").alias("n"), F.min("start").alias("start"), *[f(c).alias(f"{n}_{c}") for c in ("left", "after") for n, f in (("least", F.min), ("most", F.max))], *[F.max((F.col(c) == 0).cast("int")).alias(f"ends_{c}") for c in ("left", "after")]]
    by_doc = rows.groupBy(*key, "id").agg(*ends)
    again = [F.sum("n").alias("places"), F.count("*").alias("documents"), F.min(F.struct("id", "start")).alias("told")]
    for c in ("left", "after"):
        again += [F.min(f"least_{c}").alias(f"least_{c}"), F.max(f"most_{c}").alias(f"most_{c}"), F.max(f"ends_{c}").alias(f"ends_{c}")]
    several = lambda c: (F.col(f"least_{c}") != F.col(f"most_{c}")) | (F.col(f"ends_{c}") == 1)
    nodes = by_doc.groupBy(*key).agg(*again).filter((F.col("documents") > 1) & several("left") & several("after"))
    return nodes.select(F.col("depth").alias("words"), "places", "documents", F.col("told.id").alias("doc_id"), "told.start")


PLACES = "part int, ids binary, text_keys binary, starts binary"


def searched(width: int, parts: int):
    """Starts of windows to remove, by part of the documents."""

    def emit(docs, keys, starts):
        part, (d, k, s) = blobs((docs % parts).astype(np.int64), docs, keys, starts.astype(np.int32))
        return batch_of(["part", "ids", "text_keys", "starts"], [pa.array(part.astype(np.int32)), *(pa.array(x, pa.binary()) for x in (d, k, s))])

    def found(held: list[Suffixes]):
        s, out = Suffixes.joined(held), []
        for back in range(s.reach(width) + 1):
            own, matrix, known, _ = s.at(width, back)
            at = own[Subtree(matrix, known, s.docs[own]).repeated(width)]
            out.append((s.docs[at], s.text_keys[at], s.places[at] - np.int32(back)))
        return [np.concatenate(x) for x in zip(*out)]

    def run(batches):
        at, held = None, []
        for bucket, s in rows_of(batches, ["bucket"]):
            if bucket < 0:
                yield emit(s.docs, s.text_keys, s.places)
                continue
            if bucket != at:
                if held and len((out := found(held))[0]):
                    yield emit(*out)
                at, held = bucket, []
            held.append(s)
        if held and len((out := found(held))[0]):
            yield emit(*out)

    return run


def gathered(width: int):
    """By document the word ranges to remove, as pairs of 32-bit numbers."""

    def ranges(d, k, s):
        order = np.lexsort((s, k, d))
        d, k, s = d[order], k[order], s[order].astype(np.int64)
        other = np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])])
        begins = np.flatnonzero(other | np.concatenate([[True], s[1:] > s[:-1] + width]))
        pairs = np.column_stack([s[begins], s[np.append(begins[1:], len(s)) - 1] + width]).astype(np.int32)
        docs = np.flatnonzero(other[begins])
        return batch_of(["id", "text_key", "ranges"], [d[begins][docs], k[begins][docs], pa.array([x.tobytes() for x in np.split(pairs, docs[1:])], pa.binary())])

    def run(batches):
        renamed = (b.rename_columns(["bucket", *b.schema.names[1:]]) for b in batches)
        for _, (d, k, s) in by_bucket(renamed, ["ids", "text_keys", "starts"]):
            yield ranges(np.frombuffer(d, np.int64), np.frombuffer(k, np.int64), np.frombuffer(s, np.int32))

    return run


def removal(width: int):
    """Digest (and text) of what is left of each text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, removed, digest, texts = [], [], [], []
        for text, ranges, whole in zip(batch.column("text"), batch.column("ranges"), batch.column("whole").to_pylist()):
            words = (text.as_buffer().to_pybytes() if text.is_valid and len(text.as_buffer()) else b"").split()
            n = len(words)
            if whole and n >= width:
                words = []
            elif ranges.is_valid:
                kept, done = [], 0
                for low, high in np.frombuffer(ranges.as_py(), np.int32).reshape(-1, 2).tolist():
                    kept += words[done:low]
                    done = max(done, high)
                words = kept + words[done:]
            left = b" ".join(words)
            total.append(n)
            removed.append(n - len(words))
            digest.append(hashlib.sha256(left).hexdigest())
            texts.append(left.decode() if n != len(words) else None)
        return batch_of(
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.string())],
        )

    return run


def grouped(keyed: DataFrame, single: DataFrame, width: int) -> tuple[DataFrame, DataFrame, dict[int, np.ndarray], np.ndarray]:
    """Suffixes of the texts at shared anchors, dealt to buckets by prefix and sorted by bucket; all suffixes, the prefixes that are too
    large, and the windows that are too frequent for a bucket."""
    buckets = buckets_for(keyed)
    dealt = arrow_map(single.select("text_key", "text"), anchor_rows(width, buckets), ANCHORS).repartition("bucket").sortWithinPartitions("bucket")
    shared = map_batches(dealt, shared_anchors, "text_key bigint, shared binary").groupBy("text_key").agg(F.collect_list("shared").alias("shared"))
    suffixes = materialize(arrow_map(single.select("id", "text_key", "text").join(shared, "text_key"), suffix_rows(width), SUFFIXES), "suffixes")

    large: dict[int, np.ndarray] = {}
    total = 0
    for length in range(1, min(RUN, width) + 1):
        counts = map_batches(suffixes, counter(width, length, large), "prefix bigint, suffixes bigint").groupBy("prefix").agg(F.sum("suffixes").alias("suffixes"))
        if length == 1:
            counts = materialize(counts, "prefixes")
            total = counts.agg(F.sum("suffixes")).first()[0] or 0
        found = counts.filter(F.col("suffixes") > GROUP).select("prefix").toArrow().column("prefix").to_numpy()
        if not len(found):
            break
        large[length] = np.sort(np.ascontiguousarray(found).view(np.uint64))
    hot = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if min(RUN, width) in large:
        often = materialize(map_batches(suffixes, frequent(width, large), "window bigint, n bigint, least bigint").groupBy("window").agg(F.sum("n").alias("n"), F.min("least").alias("least")).filter(F.col("n") > GROUP), "often")
        least = often.toArrow()
        value = np.ascontiguousarray(least.column("window").to_numpy()).view(np.uint64)
        order = np.argsort(value)
        hot = (value[order], least.column("least").to_numpy()[order])
    groups = max(LEAST_BUCKETS, -(-2 * total // GROUP))
    return map_batches(suffixes, dealer(width, large, hot, groups), DEALT).repartition("bucket").sortWithinPartitions("bucket"), suffixes, large, hot[0]


def maximal_repeats(docs: DataFrame, width: int = 13, least_broadcast: int = 500_000) -> DataFrame:
    """(words, places, documents, doc_id, start): the maximal repeats of at least `width` words between different texts, in full
    length: sequences that stand in several documents and can't be extended to either side at all their places. They are told at
    their smallest doc_id. Equal texts count once, with their smallest doc_id.

    The trees of windows give the places from which a maximal repeat may begin. Their classes are read on by blocks of words, twice
    as long each round, until no two texts agree: the deeper parts of the subtrees. A class with more places than a task should
    hold is counted by prefixes instead, and split by its next words.
    """
    keyed = with_keys(docs)
    single, _ = distinct_texts(keyed, least_broadcast)
    single = single.withColumnRenamed("k1", "text_key")
    dealt, suffixes, large, hot = grouped(keyed, single, width)
    leaves = map_batches(dealt, window_leaves(width), LEAVES)
    if len(hot):
        leaves = leaves.unionByName(map_batches(suffixes, frequent_leaves(width, large, hot), LEAVES))
    leaves = materialize(leaves, "leaves")
    texts = materialize(single.join(leaves.select("id", "text_key").distinct(), ["id", "text_key"], "left_semi").select("id", "text_key", "text"), "texts")
    out, size = [], FIRST
    while not small_enough(leaves, 0):
        crowded = looked_up(leaves.groupBy("cls").count().filter(F.col("count") > GROUP).select("cls"), "crowded")
        any_crowded, ahead = not small_enough(crowded, 0), []
        for in_trees in (True, False):
            if not in_trees and not any_crowded:
                continue
            part, n = leaves.join(crowded, "cls", "left_anti" if in_trees else "left_semi") if any_crowded else leaves, size if in_trees else FEW
            of_text = part.groupBy("id", "text_key").agg(F.collect_list(F.struct("cls", "depth", "start", "left")).alias("leaves"))
            blocks = arrow_map(of_text.join(texts, ["id", "text_key"]), block_rows(n), BLOCKS, most=max(1 << 14, SLICE_BYTES * FIRST // (8 * n)))
            if in_trees:
                found = materialize(map_batches(blocks.repartition("cls").sortWithinPartitions("cls"), subtrees, FOUND), "found")
                out.append(found.filter("words IS NOT NULL").select("words", "places", "documents", "doc_id", "start"))
                ahead.append(found.filter("words IS NULL").select(*[F.col(f"next_{c.split()[0]}").alias(c.split()[0]) for c in LEAVES.split(", ")]))
            else:
                blocks = materialize(blocks, "crowded")
                out.append(materialize(by_prefix(blocks), "repeats"))
                ahead.append(arrow_map(blocks, next_leaves, LEAVES, "block"))
        leaves = materialize(ahead[0] if len(ahead) == 1 else ahead[0].unionByName(ahead[1]), "leaves")
        size = min(2 * size, MOST)
    if not out:
        return docs.sparkSession.createDataFrame([], REPEATS)
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.withColumn("doc_id", F.when(F.col("doc_id") < NO_ID, F.col("doc_id")))


def remove_repeats(docs: DataFrame, width: int = 13, least_broadcast: int = 500_000) -> DataFrame:
    """A row for each document: n_words, n_removed, kept_sha256 of its kept words joined by a space, and kept_text if any went."""
    keyed = with_keys(docs)
    single, copies = distinct_texts(keyed, least_broadcast)
    parts = buckets_for(keyed)
    dealt, *_ = grouped(keyed, single.withColumnRenamed("k1", "text_key"), width)
    places = map_batches(dealt, searched(width, parts), PLACES).repartition("part").sortWithinPartitions("part")
    removed = looked_up(map_batches(places, gathered(width), "id bigint, text_key bigint, ranges binary"), "removed", least_broadcast)
    told = keyed.withColumnRenamed("k1", "text_key").join(copies.select("id", F.col("k1").alias("text_key"), F.lit(True).alias("whole")), ["id", "text_key"], "left")
    told = told.join(removed, ["id", "text_key"], "left").select(F.when(F.col("id") < NO_ID, F.col("id")).alias("doc_id"), "text", "ranges", "whole")
    return arrow_map(told, removal(width), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")

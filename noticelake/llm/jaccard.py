"""N-gram Jaccard join by T-occurrence search.

A document's set are the 64-bit fingerprints of its distinct word shingles. Sets of similarity t or more differ in at most
D = (1-t)/(1+t) * (sum of sizes) elements. The space of elements is cut into m > D parts, so linked sets agree on m - D parts
at least; the fingerprints of a set's parts are dealt out as short sets, on which T-occurrence is searched first. m is one
number for a class of sizes; a document near the top of its class also takes part in the next one. Parts that say little -
(nearly) empty ones - are left out by any document that has fewer than m - D of them. The lists of the other parts are short
or long: lists of at most `COMMON` documents are merged (a bounded number of pairs for each entry, counted on the map side);
longer ones, such as those of a common line, are set aside. A pair is a candidate if its merged count reaches m - D less the
parts that either document left out or has in long lists. Documents to which that leaves nothing, such as members of a large
group of near copies, are linked to the least such document of each long list instead: no pairs are listed there.

The whole set of each document of a group goes to that group, once. There, inverted lists answer a T-occurrence query for
each document (T: elements that a linked set must share): short lists are merged and counted, the longest ones are set aside
and probed by binary search (DivideSkip), and documents that reach T and the similarity are linked. Candidates already
connected are not verified again, so a group of thousands of near copies costs a spanning tree of links. Groups above a
bounded size are dealt to tasks by pairs of blocks. Components of the links follow by star contraction.

Nulls: a null text has an empty set and is linked with nothing, as is one without words; rows with a null doc_id are
documents apart by text, after all others: a group of only such rows has a null component. Rows that share a doc_id are one
document of the graph and each get a result row. Ties go to the smaller doc_id. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NO_ID, arrow_map, batch_of, blobs, bucket_of, buckets_for, distinct_texts, join_on, looked_up, map_batches, materialize, mix, sheltered, slices, small_enough, window_hashes, with_keys, Words
from .graph import components

#: Sizes in a class differ by this factor at most.
CLASS_RATIO = 1.4
#: Elements that a task holds at once; larger groups are cut into blocks.
GROUP_ELEMENTS = 2_000_000
#: A list of a part with more documents is long.
COMMON = 8
#: Parts that a task holds before it deals them out.
HELD_PARTS = 400_000


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints of all texts, flat and sorted by text, and offsets."""
    words = Words(texts, LOWER)
    hashes, counts, offsets = words.hashes(), words.counts, words.offsets
    n = len(hashes)
    runs = window_hashes(hashes, width)
    doc = words.doc_of()
    inside = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :]) if n >= width else np.zeros(0, np.int64)
    owner, element = doc[inside], runs[inside]
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        whole = np.array([mix(np.array([hash_run(hashes[offsets[i] : offsets[i + 1]])], np.uint64))[0] for i in few], np.uint64)
        owner, element = np.concatenate([owner, few]), np.concatenate([element, whole])
    order = np.lexsort((element, owner))
    owner, element = owner[order], element[order]
    if len(owner):
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (element[1:] != element[:-1])
        owner, element = owner[new], element[new]
    return element, np.searchsorted(owner, np.arange(len(counts) + 1))


def hash_run(hashes: np.ndarray) -> int:
    total = len(hashes)
    for h in hashes.tolist():
        total = (total * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
    return total


def size_classes(most: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Upper ends of the classes of sizes up to `most`; D and m of each class; elements up to which a part says little."""
    ratio = max(CLASS_RATIO, 100 / percent)  # so that linked sets lie in the same class or in neighbouring ones
    tops = [1]
    while tops[-1] < most:
        tops.append(max(tops[-1] + 1, int(tops[-1] * ratio)))
    tops = np.array(tops, np.int64)
    differ = 2 * tops * (100 - percent) // (100 + percent)
    parts = differ + np.maximum(1, np.where(differ > 8, differ // 4 + 2, 1 + differ // 4))
    mean = np.concatenate([[1], tops[:-1] + 1]) / parts  # elements of a part, in the smallest sets of the class
    few = (1 + mean) * np.exp(-mean) * parts < (parts - differ) / 2
    return tops, differ, parts, few.astype(np.int64)


def part_rows(width: int, percent: int, buckets: int):
    """Of each document the fingerprints of its parts, by bucket; and a row with sizes of a slice's documents.

    A list that is long among the parts a task holds is long: its entries need no bucket, which gets one mark of it instead. So a
    bucket has for each list at most `COMMON` entries, or a mark, of each `HELD_PARTS` parts, whatever share of the texts is in it.
    """

    def parts_of(element, sizes, chosen, level, ids, differ, parts, few):
        """Fingerprints, ids and notes (size, level, how many parts may be left out) for documents `chosen`, cut as class `level` has it."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        use = chosen[owner]
        element, owner = element[use], owner[use]
        if not len(element):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        m = parts[level[owner]].astype(np.uint64)
        part = ((element >> np.uint64(32)) * m >> np.uint64(32)).astype(np.int64)  # elements are in order, so parts are
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])]))
        held = np.diff(np.append(first, len(element)))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(element ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        print_ = total[np.append(first[1:], len(element))] - total[first]
        whose, part = owner[first], part[first]
        telling = held > few[level[whose]]
        weak = parts[level] - np.bincount(whose[telling], minlength=len(sizes))
        allowed = parts[level] - differ[level]
        told = telling | (weak >= allowed)[whose]
        print_, whose, part = print_[told], whose[told], part[told]
        none = np.flatnonzero(chosen & (weak >= allowed))  # these need their empty parts too
        full = np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=len(sizes)))])
        empty = []
        for d in none.tolist():
            have = ((element[first[full[d] : full[d + 1]]] >> np.uint64(32)) * np.uint64(parts[level[d]]) >> np.uint64(32)).astype(np.int64)
            empty.append(np.setdiff1d(np.arange(parts[level[d]]), have))
        if empty:
            print_ = np.concatenate([print_, np.zeros(sum(map(len, empty)), np.uint64)])
            whose = np.concatenate([whose, np.repeat(none, [len(x) for x in empty])])
            part = np.concatenate([part, *empty])
        key = mix(print_ ^ mix(part.astype(np.uint64) * np.uint64(1 << 20) + level[whose].astype(np.uint64) + np.uint64(1)))
        spare = np.clip(allowed - weak, 0, 255)
        return key, ids[whose], (sizes + (level << 32) + (spare << 40))[whose]

    def parts_and_sizes(batch: pa.RecordBatch):
        element, offsets = shingle_sets(batch.column("text"), width)
        sizes, ids = np.diff(offsets), batch.column("id").to_numpy()
        tops, differ, parts, few = size_classes(int(sizes.max()) * 2 + 4, percent)
        level = np.searchsorted(tops, sizes)
        own = parts_of(element, sizes, sizes > 0, level, ids, differ, parts, few)
        upper = (sizes > 0) & (100 * sizes >= percent * (tops[level] + 1))  # can be linked with a set of the next class
        above = parts_of(element, sizes, upper, level + 1, ids, differ, parts, few)
        return [np.concatenate(x) for x in zip(own, above)], (batch.column("k1").to_numpy().astype(np.int64), ids, sizes.astype(np.int64))

    def rows(kind, bucket, keys, docs, notes):
        arrays = [pa.array(bucket, pa.int32()), pa.array([kind] * len(bucket), pa.int32()), *(pa.array(x, pa.binary()) for x in (keys, docs, notes))]
        return batch_of([c.split()[0] for c in PARTS.split(", ")], arrays)

    def dealt(held):
        """What a task holds: short lists by bucket, those it knows to be long as they are, and a mark of each for its bucket."""
        key, doc, note = (np.concatenate(x) for x in zip(*held))
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        long = count[at] > COMMON
        marks = np.unique(key[long])
        key_, doc_, note_ = np.concatenate([key[~long], marks]), np.concatenate([doc[~long], np.zeros(len(marks), np.int64)]), np.concatenate([note[~long], np.full(len(marks), LONG)])
        bucket, lists = blobs(bucket_of(key_, buckets), key_, doc_, note_)
        if len(bucket):
            yield rows(LISTS, bucket, *lists)
        where = np.flatnonzero(long)
        for low in range(0, len(where), 50_000):
            some = where[low : low + 50_000]
            yield rows(KNOWN, [int(doc[some[0]]) % buckets], *([np.ascontiguousarray(x[some]).tobytes()] for x in (key, doc, note)))

    def run(batches):
        held, size = [], 0
        for batch in slices(batches, "text"):
            parts, told = parts_and_sizes(batch)
            yield rows(SIZES, [int(told[1][0]) % buckets], *([x.tobytes()] for x in told))
            held.append(parts)
            size += len(parts[0])
            if size >= HELD_PARTS:
                yield from dealt(held)
                held, size = [], 0
        if size:
            yield from dealt(held)

    return run


PARTS = "bucket int, kind int, keys binary, docs binary, notes binary"
#: Rows of PARTS: lists of a bucket, sizes of documents, entries of lists known to be long. The note that marks a list as long.
LISTS, SIZES, KNOWN = 0, 1, 2
LONG = -1
FOUND = "kind int, a bigint, b bigint, n bigint, c bigint"
PAIR, DOCUMENT, SHARED = 0, 1, 2


def merged_lists(percent: int):
    """PAIR rows: documents a and b of fitting sizes agree on c parts with short lists; n holds the level and what either can leave
    out. SHARED rows: document a is in the long list of part b, with note n. DOCUMENT rows pass through: a is the document, b its
    text's key, n the size of its set.
    """

    def rows(kind, a, b, n, c):
        return batch_of(["kind", "a", "b", "n", "c"], [pa.array(np.full(len(a), kind, np.int32)), *(np.ascontiguousarray(x) for x in (a, b, n, c))])

    def joined(key, doc, note):
        e, d, note = np.frombuffer(key, np.uint64), np.frombuffer(doc, np.int64), np.frombuffer(note, np.int64)
        order = np.lexsort((d, e))
        e, d, note = e[order], d[order], note[order]
        marked, real = np.unique(e[note == LONG]), note != LONG
        e, d, note = e[real], d[real], note[real]
        if not len(e):
            return
        size, level, spare = note & 0xFFFFFFFF, (note >> 32) & 0xFF, note >> 40
        first = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
        count = np.diff(np.append(first, len(e)))
        long = np.repeat(count > COMMON, count) | np.isin(e, marked)
        pairs = []
        for step in range(1, COMMON):
            i = np.flatnonzero((e[step:] == e[:-step]) & ~long[step:])
            if not len(i):
                break
            j = i + step
            i, j = (x[(d[i] != d[j]) & (100 * size[i] >= percent * size[j]) & (100 * size[j] >= percent * size[i])] for x in (i, j))
            pairs.append(np.column_stack([d[i], d[j], level[i] | (spare[i] << 8) | (spare[j] << 16)]))
        if pairs and len(p := np.concatenate(pairs)):
            found, times = np.unique(p, axis=0, return_counts=True)
            yield rows(PAIR, found[:, 0], found[:, 1], found[:, 2], times.astype(np.int64))
        if long.any():
            yield rows(SHARED, d[long], e[long].view(np.int64), note[long], np.ones(long.sum(), np.int64))

    def run(batches):
        at, held = None, ([], [], [])
        for b in batches:
            for bucket, kind, *row in zip(*(b.column(n).to_pylist() for n in ("bucket", "kind", "keys", "docs", "notes"))):
                if kind == KNOWN:
                    part, doc, note = (np.frombuffer(x, np.int64) for x in row)
                    yield rows(SHARED, doc, part, note, np.ones(len(doc), np.int64))
                    continue
                if kind == SIZES:
                    sizes = np.frombuffer(row[2], np.int64)
                    yield rows(DOCUMENT, np.frombuffer(row[1], np.int64), np.frombuffer(row[0], np.int64), sizes, np.zeros(len(sizes), np.int64))
                    continue
                if bucket != at:
                    if at is not None:
                        yield from joined(*(b"".join(h) for h in held))
                    at, held = bucket, ([], [], [])
                for h, v in zip(held, row):
                    h.append(v)
        if at is not None:
            yield from joined(*(b"".join(h) for h in held))

    return run


def candidate_edges(found: DataFrame, most_rows: int) -> DataFrame:
    """(a, b): pairs that reach their count over short lists, and documents that only long lists can tell, each with the least of its
    list. Counts and minima are summed on the map side; joins have one row for each key on one side.
    """
    byte = lambda c, k: F.shiftright(c, k).bitwiseAND(F.lit(255))
    shared = found.filter(F.col("kind") == SHARED).select(F.col("a").alias("id"), F.col("b").alias("part"), byte("n", 32).alias("level"), byte("n", 40).alias("spare"))
    long = shared.groupBy("id", "level").agg(F.count("*").alias("parts"), F.max("spare").alias("spare"))
    long = looked_up(long, "long", most_rows)
    pairs = found.filter(F.col("kind") == PAIR).groupBy("a", "b", "n").agg(F.sum("c").alias("c"))
    pairs = pairs.select("a", "b", "c", byte("n", 0).alias("level"), byte("n", 8).alias("spare_a"), byte("n", 16).alias("spare_b"))
    for x in ("a", "b"):
        pairs = pairs.join(long.select(F.col("id").alias(x), "level", F.col("parts").alias(f"long_{x}")), [x, "level"], "left")
    left = lambda x: F.col(f"spare_{x}") - F.coalesce(f"long_{x}", F.lit(0))
    pairs = pairs.filter((F.col("c") >= left("a")) & (F.col("c") >= left("b"))).select("a", "b")
    kept = materialize(shared.join(long.filter("parts >= spare").select("id", "level"), ["id", "level"], "left_semi").select("id", "part"), "common")
    least = kept.groupBy("part").agg(F.min("id").alias("b"))
    return pairs.unionByName(kept.join(least, "part").filter("id != b").select(F.col("id").alias("a"), "b"))


def whole_sets(width: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        element, offsets = shingle_sets(batch.column("text"), width)
        data = [element[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
        return batch_of(["component", "parts", "id", "elements"], [batch.column("component"), batch.column("parts"), batch.column("id"), pa.array(data, pa.binary())])

    return run


class Group:
    """Sets of a candidate group, with inverted lists over them.

    Documents whose elements have the longest lists come first: the common source of near copies before the copies, so that
    each copy is connected by its first verification.
    """

    def __init__(self, docs: np.ndarray, sets: list[np.ndarray], block: np.ndarray):
        sizes = np.array([len(s) for s in sets], np.int64)
        _, token, length = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        mean = np.add.reduceat(length[token], np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes
        order = np.lexsort((docs, -mean))
        token = [x for x in np.split(token.astype(np.int64), np.cumsum(sizes)[:-1])]
        self.docs, self.block, self.sizes, self.lengths = docs[order], block[order], sizes[order], length
        self.tokens = [token[i] for i in order]
        owner = np.repeat(np.arange(len(docs)), self.sizes)
        self.keys = np.sort(np.concatenate(self.tokens) * len(docs) + owner)
        self.lists = self.keys % len(docs)
        self.starts = np.concatenate([[0], np.cumsum(length)])
        self.parent = np.arange(len(docs))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = int(self.parent[i])
        return i

    def roots(self, of: np.ndarray) -> np.ndarray:
        r = self.parent[of]
        while (self.parent[r] != r).any():
            r = self.parent[r]
        return r

    def merged(self, tokens: np.ndarray) -> np.ndarray:
        return np.concatenate([self.lists[self.starts[t] : self.starts[t + 1]] for t in tokens]) if len(tokens) else np.zeros(0, np.int64)

    def links(self, percent: int):
        """Pairs of documents that connect all linked ones, across the two blocks if there are two."""
        two = len(np.unique(self.block)) > 1
        for i in range(1, len(self.docs)):
            n = int(self.sizes[i])
            least = -(-percent * n // 100)  # elements shared with any linked set
            tokens = self.tokens[i][np.argsort(self.lengths[self.tokens[i]], kind="stable")]
            longest = int(self.lengths[tokens[-1]])
            set_aside = min(least - 1, int(least / (0.0085 * np.log2(longest + 1) + 1))) if longest > 1 else 0
            short, long = tokens[: n - set_aside], tokens[n - set_aside :]
            found = self.merged(short)
            found = found[found < i]
            near, counts = np.unique(found, return_counts=True)
            fits = (counts >= least - set_aside) & (percent * self.sizes[near] <= 100 * n) & (percent * n <= 100 * self.sizes[near])
            near, counts = near[fits], counts[fits]
            order = np.argsort(-counts, kind="stable")
            near, counts, whole, tried = near[order], counts[order], False, 0
            while True:
                other = self.roots(near) != self.root(i)
                if two:
                    other &= self.block[near] != self.block[i]
                near, counts = near[other], counts[other]
                if not len(near):
                    break
                if not whole and tried >= 8:  # many candidates: merging the long lists too costs less than probing for each
                    counts = counts + np.bincount(self.merged(long), minlength=len(self.docs))[near]
                    whole = True
                    linked = 100 * counts >= percent * (n + self.sizes[near] - counts)
                    near, counts = near[linked], counts[linked]
                    continue
                j, shared = int(near[0]), int(counts[0])
                near, counts = near[1:], counts[1:]
                if not whole:
                    probes = long * len(self.docs) + j
                    at = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
                    shared += int((self.keys[at] == probes).sum())
                    tried += 1
                if 100 * shared >= percent * (n + int(self.sizes[j]) - shared):
                    self.parent[self.root(i)] = self.root(j)
                    yield int(self.docs[i]), int(self.docs[j])


def searched(percent: int):
    def run(batches):
        at, docs, sets, block, out = None, [], [], [], []

        def close():
            if len(docs) > 1:
                out.extend(Group(np.array(docs, np.int64), sets, np.array(block, np.int64)).links(percent))

        for b in batches:
            for key, doc, part, data in zip(zip(*(b.column(n).to_pylist() for n in ("component", "block_a", "block_b"))), b.column("id").to_pylist(), b.column("part").to_pylist(), b.column("elements").to_pylist()):
                if key != at:
                    close()
                    at, docs, sets, block = key, [], [], []
                docs.append(doc)
                sets.append(np.frombuffer(data, np.uint64))
                block.append(part)
            if len(out) > 10_000:
                yield batch_of(["a", "b"], [pa.array(c, pa.int64()) for c in zip(*out)])
                out.clear()
        close()
        if out:
            yield batch_of(["a", "b"], [pa.array(c, pa.int64()) for c in zip(*out)])

    return run


def jaccard_groups(docs: DataFrame, width: int = 3, percent: int = 90, least_broadcast: int = 1_000_000) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (smallest doc_id reachable over links)."""
    keyed = with_keys(docs)
    buckets = buckets_for(keyed)
    single, copies = distinct_texts(keyed, least_broadcast)
    dealt = map_batches(single.select("id", "k1", "text"), part_rows(width, percent, buckets), PARTS).repartition("bucket").sortWithinPartitions("bucket")
    found = materialize(map_batches(dealt, merged_lists(percent), FOUND), "lists")
    sizes = found.filter(F.col("kind") == DOCUMENT).select(F.col("a").alias("id"), F.col("b").alias("k1"), "n")

    candidates = components(candidate_edges(found, least_broadcast))
    sized = candidates.join(sizes.groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n")), "node")
    parts = sized.groupBy("component").agg(F.ceil(F.sum("n") / GROUP_ELEMENTS).cast("int").alias("parts"))
    grouped = looked_up(sized.join(parts, "component").select(F.col("node").alias("id"), "component", "parts"), "candidates", least_broadcast)
    sets = arrow_map(single.select("id", "text").join(grouped, "id"), whole_sets(width), "component bigint, parts int, id bigint, elements binary")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    sets = sets.withColumn("part", part).withColumn("other", other).withColumns({"block_a": F.least("part", "other"), "block_b": F.greatest("part", "other")})
    sets = sets.drop("other", "parts").repartition("component", "block_a", "block_b").sortWithinPartitions("component", "block_a", "block_b", "id")
    links = materialize(map_batches(sets, searched(percent), "a bigint, b bigint"), "links")  # else two Python workers a task
    reached = looked_up(components(links).select(F.col("node").alias("first"), "component"), "reached", least_broadcast)

    member = keyed.select("id", "k1").join(copies, ["id", "k1"], "left").withColumn("first", F.coalesce("first", "id"))
    sizes = sizes.select(F.col("id").alias("first"), "k1", "n")
    out = member.join(sizes, ["first", "k1"], "left").join(reached, "first", "left")
    real = lambda c: F.when(c < NO_ID, c)
    own = F.when(F.col("n") > 0, F.coalesce("component", "first")).otherwise(F.col("id"))
    return out.select(real(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(own).alias("component_id"))


#: Numbers of texts that doc_id alone does not name: above real ones, below NO_ID.
NUMBERED = NO_ID - (1 << 54)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, least_broadcast: int = 1_000_000) -> DataFrame:
    """The documents, of each group of linked texts the one with the smallest doc_id (then text key; rows without doc_id last).

    A document is its doc_id and text: of rows that share both, one stays; texts that share only a doc_id, or have none, are
    numbered and decided each by itself.
    """
    return sheltered(docs, lambda d: _one_of_each(d, width, percent, least_broadcast))


def _one_of_each(docs: DataFrame, width: int, percent: int, least_broadcast: int) -> DataFrame:
    names, text = docs.columns, F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = {"__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit(1), text, F.length(text))}
    texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), text.alias("text")).withColumns(key).drop("text")
    shared = texts.groupBy("__doc").agg(*[f(k).alias(f"{n}{k}") for k in key for n, f in (("low", F.min), ("high", F.max))])
    shared = looked_up(shared.filter("__doc IS NULL OR low__k1 <> high__k1 OR low__k2 <> high__k2").select("__doc"), "shared", least_broadcast)
    odd = join_on(texts, shared, ["__doc"], "left_semi").distinct() if not small_enough(shared, 0) else None
    keyed, node = docs, F.col("doc_id").cast("long")
    if odd is not None:
        odd = looked_up(odd.withColumn("__number", F.lit(NUMBERED) + F.monotonically_increasing_id()), "numbered", least_broadcast)
        keyed = join_on(docs.withColumn("__doc", node).withColumns(key), odd, ["__doc", *key], "left")
        node = F.coalesce("__number", "__doc")
    keyed = keyed.withColumn("__node", node).select(*names, "__node")

    found = materialize(jaccard_groups(keyed.select(F.col("__node").alias("doc_id"), "text"), width, percent, least_broadcast).select(F.col("doc_id").alias("__node"), F.col("component_id").alias("component")), "groups")
    if odd is None:
        gone = found.filter(F.col("__node") != F.col("component")).select("__node").distinct()
    else:  # numbers are in no order: the first of a group goes by doc_id and text key
        named = found.distinct().join(odd.withColumnRenamed("__number", "__node"), "__node", "left")
        doc = F.when(F.col("__node") < NUMBERED, F.col("__node")).otherwise(F.col("__doc"))
        named = named.select("__node", "component", F.struct(doc.isNull().alias("none"), doc.alias("doc"), "__k1", "__k2").alias("place"))
        first = named.groupBy("component").agg(F.min_by("__node", "place").alias("first"))
        gone = named.join(first, "component").filter(F.col("__node") != F.col("first")).select("__node")
    gone = looked_up(gone, "gone", least_broadcast)
    kept = keyed.join(gone, "__node", "left_anti")
    twice = looked_up(found.groupBy("__node").count().filter("count > 1").select("__node").join(gone, "__node", "left_anti"), "twice", least_broadcast)
    if not small_enough(twice, 0):
        again = kept.join(twice, "__node", "left_semi").dropDuplicates(["__node"])
        kept = kept.join(twice, "__node", "left_anti").unionByName(again)
    return kept.select(*names)

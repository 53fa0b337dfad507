"""Token ids of a corpus in compressed shards: a wavelet matrix for each run of documents.

Documents are sorted by doc_id across the cluster, encoded, and cut into shards of whole documents. A shard is one sequence of
bytes that needs no other: the alphabet with its counts, the documents' ids and lengths, and a bit-plane for each bit of the
codes. Codes are as long as an id is rare (Huffman), and chosen so that ids whose code ends at a plane stand last below it: a
plane holds the bits of those that go on only, so planes take about the ids' entropy. Planes are cut into blocks, kept raw or
compressed, each with the count of set bits before it: a token, a count or a place is found from a few blocks.

Shards are rows of a written Parquet table (bytes in a column): Spark's commit makes a lost executor's half-written files
vanish, and any store that Spark reaches can hold them.

Order: doc_id ascending, null last; rows that share a doc_id by their texts' hashes, equal rows by their place. The place is
the scan's, so `docs` that come from a shuffle should be written first. Nulls: a null text is empty and becomes the end id
alone. An empty table gives no shards and an empty result; extra columns are ignored. A text longer than a shard is a shard of
its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, file_bytes, looked_up, map_batches, materialize, slices
from .tokens import word_tokenizer

MAGIC = b"WAVM"
#: Ids after which a shard is closed.
SHARD_IDS = 1 << 20
#: Bytes of a plane's block, the least that is read for a bit.
BLOCK = 4096
#: Bytes of text encoded at a time.
SLICE = 2 << 20
#: Bytes of the input's files for each sorted partition.
PARTITION_BYTES = 16 << 20
NULL = -(1 << 63)
SHARDS = "part bigint, start bigint, n_docs bigint, n_ids bigint, first_doc bigint, last_doc bigint, data binary"


def packed(values: np.ndarray) -> bytes:
    raw = zstandard.ZstdCompressor(level=1).compress(values.tobytes())
    return struct.pack("<I", len(raw)) + raw


def plane_bytes(bits: np.ndarray) -> bytes:
    """Set bits in all, counts before blocks, ends of blocks, then the blocks; a block shorter than its raw length is compressed."""
    rows = np.packbits(bits, bitorder="little").tobytes()
    blocks, sizes, squeeze = [], [], zstandard.ZstdCompressor(level=1)
    for at in range(0, len(rows), BLOCK):
        raw = rows[at : at + BLOCK]
        small = squeeze.compress(raw)
        blocks.append(small if len(small) < len(raw) * 0.95 else raw)
        sizes.append(len(blocks[-1]))
    ones = np.add.reduceat(np.bitwise_count(np.frombuffer(rows, np.uint8)).astype(np.uint32), np.arange(0, len(rows), BLOCK)) if rows else np.zeros(0, np.uint32)
    before = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
    return before.tobytes() + np.cumsum(sizes).astype("<u4").tobytes() + b"".join(blocks)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths for counts in falling order, by merging from the rear; balanced ones should a code exceed 31 bits."""
    n = len(counts)
    if n < 2:
        return np.zeros(n, np.int64)
    weight, parent = counts.tolist() + [0] * (n - 1), [0] * (2 * n - 1)
    leaf, inner = n - 1, n
    for made in range(n, 2 * n - 1):
        for _ in range(2):  # the lighter of the next leaf and the next inner node
            if leaf >= 0 and (inner >= made or weight[leaf] <= weight[inner]):
                least, leaf = leaf, leaf - 1
            else:
                least, inner = inner, inner + 1
            weight[made] += weight[least]
            parent[least] = made
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    lengths = np.array(depth[:n], np.int64)
    if lengths.max() > 31:
        full = (n - 1).bit_length()
        lengths = np.where(np.arange(n) < (1 << full) - n, full - 1, full)
    return lengths


def codes_of(ends: np.ndarray) -> np.ndarray:
    """Codes, from the highest bit of 32 down, for as many ids as end below each plane (ids in order of their ends).

    Below a plane the sequence is in the order of the reversed prefixes; the last of these end, the others go on.
    """
    nodes, out = np.zeros(1, np.uint64), []
    for level, k in enumerate(ends.tolist()):
        below = np.concatenate([nodes, nodes | np.uint64(1 << (31 - level))])
        nodes = below[: len(below) - k]
        out.append(below[len(below) - k :])
    return np.concatenate(out).astype(np.uint32) if out else np.zeros(1, np.uint32)


def shard_bytes(ids: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> bytes:
    """One shard of documents of these lengths; `docs` are their ids, NULL for none."""
    top = int(ids.max()) + 1 if len(ids) else 0
    if top <= 1 << 20:  # a table of all ids is small
        counts, found = np.bincount(ids, minlength=top), None
        alphabet = np.flatnonzero(counts)
        counts = counts[alphabet]
    else:
        alphabet, found, counts = np.unique(ids, return_inverse=True, return_counts=True)
    falling = np.argsort(-counts, kind="stable")
    long = code_lengths(counts[falling])
    ends = np.bincount(long, minlength=1)[1:]
    order = falling[np.argsort(long, kind="stable")]
    codes = np.zeros(len(alphabet), np.uint32)
    codes[order] = codes_of(ends)[: len(order)]
    if found is None:
        table = np.zeros(top, np.uint32)
        table[alphabet] = codes
        going = table[ids]
    else:
        going = codes[found]
    alphabet, counts = alphabet[order], counts[order]
    leaving, planes = np.add.reduceat(counts, np.concatenate([[0], np.cumsum(ends)[:-1]])) * (ends > 0) if len(ends) else [], []
    for level, gone in enumerate(leaving):
        bits = (going & np.uint32(1 << (31 - level))) != 0
        planes.append(plane_bytes(bits))
        mask = pa.array(bits)
        values = pa.array(going)
        going = np.concatenate([values.filter(pc.invert(mask)).to_numpy(), values.filter(mask).to_numpy()])[: len(going) - int(gone)]
    head = packed(alphabet.astype("<u4")) + packed(counts.astype("<u4")) + packed(docs.astype("<i8")) + packed(lengths.astype("<i8"))
    body = struct.pack("<QIHH", len(ids), len(alphabet), len(planes), 0) + struct.pack(f"<{2 * len(planes)}I", *map(len, planes), *ends.tolist()) + head + b"".join(planes)
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


class Plane:
    """A bit-plane with rank and select; blocks are opened as they are asked for."""

    def __init__(self, data: memoryview, n: int):
        self.n, blocks = n, -(-n // (8 * BLOCK))
        self.before = np.frombuffer(data, "<u4", blocks + 1)
        self.ends = np.frombuffer(data, "<u4", blocks, 4 * (blocks + 1))
        self.data, self.opened = data[4 * (2 * blocks + 1) :], {}
        self.ones, self.zeros = int(self.before[-1]), n - int(self.before[-1])

    def block(self, k: int) -> np.ndarray:
        if k not in self.opened:
            raw, size = self.data[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])], min(BLOCK, -(-self.n // 8) - k * BLOCK)
            self.opened[k] = np.frombuffer(raw if len(raw) == size else zstandard.ZstdDecompressor().decompress(raw, size), np.uint8)
        return self.opened[k]

    def bits(self) -> np.ndarray:
        """All bits."""
        rows = np.concatenate([self.block(k) for k in range(len(self.ends))]) if self.n else np.zeros(0, np.uint8)
        self.opened.clear()
        return np.unpackbits(rows, count=self.n, bitorder="little").view(bool)

    def get(self, i: int) -> int:
        return int(self.block(i // (8 * BLOCK))[i % (8 * BLOCK) // 8]) >> (i & 7) & 1

    def rank1(self, i: int) -> int:
        """Set bits before place i."""
        k, inside = divmod(i, 8 * BLOCK)
        if not inside:
            return int(self.before[k])
        rows = self.block(k)
        part = int(rows[inside // 8]) & ((1 << (inside & 7)) - 1) if inside & 7 else 0
        return int(self.before[k]) + int(np.bitwise_count(rows[: inside // 8]).sum()) + part.bit_count()

    def select(self, bit: int, ranks: np.ndarray) -> np.ndarray:
        """Places of the bits with these ranks (from 0, ascending) among those equal to `bit`."""
        before = self.before.astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(len(before)) * 8 * BLOCK, self.n) - before
        block, out = np.searchsorted(before, ranks, side="right") - 1, np.empty(len(ranks), np.int64)
        for k in np.unique(block).tolist():
            low, high = np.searchsorted(block, [k, k + 1])
            count = min(8 * BLOCK, self.n - k * 8 * BLOCK)
            places = np.flatnonzero(np.unpackbits(self.block(k), count=count, bitorder="little") == bit)
            out[low:high] = k * 8 * BLOCK + places[ranks[low:high] - before[k]]
        return out


class Shard:
    """Reads one shard: documents, tokens by place, counts and places of a token."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:4]) != MAGIC or zlib.crc32(view[8:]) != struct.unpack("<I", view[4:8])[0]:
            raise ValueError("not a shard, or a damaged one")
        self.n, _, depth, _ = struct.unpack("<QIHH", view[8:24])
        numbers, at = struct.unpack(f"<{2 * depth}I", view[24 : 24 + 8 * depth]), 24 + 8 * depth
        parts = []
        for kind in ("<u4", "<u4", "<i8", "<i8"):
            (long,) = struct.unpack("<I", view[at : at + 4])
            parts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(view[at + 4 : at + 4 + long]), kind))
            at += 4 + long
        self.alphabet, counts, self.docs, self.lengths = parts
        self.counts = counts.astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        #: ids whose code ends below each plane: from self.ends[level] to self.ends[level + 1] in the alphabet
        self.ends = np.concatenate([[0], np.cumsum(numbers[depth:], dtype=np.int64)])
        self.planes, going = [], self.n
        for level, long in enumerate(numbers[:depth]):
            self.planes.append(Plane(view[at : at + long], going))
            going -= int(self.counts[self.ends[level] : self.ends[level + 1]].sum())
            at += long
        self.sought: dict[int, tuple[int, int]] | None = None

    def code_of(self, token: int) -> tuple[int, int] | None:
        """The code and its length, None for an id that the shard does not hold."""
        if self.sought is None:
            codes = codes_of(np.diff(self.ends)).tolist()
            long = np.repeat(np.arange(1, len(self.planes) + 1), np.diff(self.ends)).tolist() if self.planes else [0] * len(self.alphabet)
            self.sought = dict(zip(self.alphabet.tolist(), zip(codes, long)))
        return self.sought.get(int(token))

    def ids(self) -> np.ndarray:
        """All ids: stable partitions undone from the last plane up."""
        small = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        places = np.zeros(0 if self.planes else self.n, small)  # in the alphabet
        for level in range(len(self.planes) - 1, -1, -1):
            plane, (low, high) = self.planes[level], self.ends[level : level + 2]
            below = np.concatenate([places, np.repeat(np.arange(low, high, dtype=small), self.counts[low:high])])
            bits, places = plane.bits(), np.empty_like(below)
            places[np.flatnonzero(~bits)] = below[: plane.zeros]
            places[np.flatnonzero(bits)] = below[plane.zeros :]
        return self.alphabet[places]

    def access(self, i: int) -> int:
        """The id at place i."""
        for level, plane in enumerate(self.planes):
            bit, ones = plane.get(i), plane.rank1(i)
            i = plane.zeros + ones if bit else i - ones
            low, high = self.ends[level : level + 2]
            counts = self.counts[low:high]
            going = plane.n - int(counts.sum())
            if i >= going:
                return int(self.alphabet[low + np.searchsorted(going + np.cumsum(counts), i, side="right")])
        return int(self.alphabet[0])

    def interval(self, code: tuple[int, int], low: int, high: int) -> tuple[int, int]:
        """Where the code's occurrences at places low to high - 1 stand below its last plane."""
        for level in range(code[1]):
            plane = self.planes[level]
            if code[0] >> (31 - level) & 1:
                low, high = plane.zeros + plane.rank1(low), plane.zeros + plane.rank1(high)
            else:
                low, high = low - plane.rank1(low), high - plane.rank1(high)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a token at places low to high - 1."""
        code = self.code_of(token)
        if code is None:
            return 0
        low, high = self.interval(code, min(low, self.n), self.n if high is None else min(high, self.n))
        return high - low

    def places(self, token: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """Places of a token, ascending, among places low to high - 1."""
        code = self.code_of(token)
        if code is None:
            return np.zeros(0, np.int64)
        at = np.arange(*self.interval(code, min(low, self.n), self.n if high is None else min(high, self.n)))
        for level in range(code[1] - 1, -1, -1):
            plane, bit = self.planes[level], code[0] >> (31 - level) & 1
            at = plane.select(bit, at - plane.zeros if bit else at)
        return at


def writer(path: str, end_id: int, shard_ids: int):
    def run(batches):
        part, tokenizer = TaskContext.get().partitionId(), word_tokenizer(path)
        start, held, lengths, docs = 0, [], [], []

        def closed():
            nonlocal start
            ids, sizes, names = np.concatenate(held), np.array(lengths, np.int64), np.array([NULL if d is None else d for d in docs], np.int64)
            row = (part, start, len(docs), len(ids), docs[0], docs[-1], shard_bytes(ids, sizes, names))
            start += len(ids)
            held.clear(), lengths.clear(), docs.clear()
            kinds = [pa.int64()] * 6 + [pa.binary()]
            return batch_of(["part", "start", "n_docs", "n_ids", "first_doc", "last_doc", "data"], [pa.array([v], k) for v, k in zip(row, kinds)])

        open_ids = 0
        for batch in slices(batches, "text", SLICE):
            ids, offsets = tokenizer.batch_ids(pc.fill_null(batch.column("text"), ""), end_id)
            names, low = batch.column("doc_id").to_pylist(), 0
            while low < len(names):  # as many documents as the open shard takes, one at least if it is empty
                high = int(np.searchsorted(offsets, offsets[low] + shard_ids - open_ids, side="right")) - 1
                high = min(max(high, low + (not open_ids)), len(names))
                if high > low:
                    held.append(ids[offsets[low] : offsets[high]].astype(np.uint32))
                    lengths.extend(np.diff(offsets[low : high + 1]).tolist())
                    docs.extend(names[low:high])
                    open_ids += int(offsets[high] - offsets[low])
                if high < len(names):
                    yield closed()
                    open_ids = 0
                low = high
        if docs:
            yield closed()

    run.keeps_tables = True
    return run


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shard_ids: int = SHARD_IDS, label: str = "wavelet") -> DataFrame:
    """The written table of shards: (part, start, n_docs, n_ids, first_doc, last_doc, data).

    `part` ascends with doc_id, `start` counts the ids before the shard within its part.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    placed = narrow.withColumns({"k": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-file_bytes(docs) // PARTITION_BYTES), 100_000))
    order = [F.col("doc_id").asc_nulls_last(), F.col("k"), F.col("place")]
    dealt = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialize(map_batches(dealt, writer(tokenizer_path, end_id, shard_ids), SHARDS), label)


def with_base(shards: DataFrame) -> DataFrame:
    """With `base`, the ids before the shard in the whole corpus. One row for each part goes through the running sum."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = looked_up(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base")), "bases")
    return shards.join(bases, "part").withColumn("base", F.col("__base") + F.col("start")).drop("__base")


def over_shards(shards: DataFrame, fn, schema: str) -> DataFrame:
    """fn(base, shard) yields record batches; one shard is open at a time."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k, base in enumerate(batch.column("base").to_pylist()):
                yield from fn(base, Shard(batch.column("data")[k].as_buffer()))

    return map_batches(with_base(shards).select("base", "data"), run, schema)


def doc_ids(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NULL)


def read_documents(shards: DataFrame, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the shards; with keep_ids also the ids (binary, 32-bit little-endian)."""

    def decoded(base: int, shard: Shard):
        raw, bounds = memoryview(np.ascontiguousarray(shard.ids(), "<u4")).cast("B"), (4 * shard.starts).tolist()
        pieces = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        columns = [doc_ids(shard.docs), base + shard.starts[:-1], shard.lengths, pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        yield batch_of([*names, "ids"], [*columns, pa.array([bytes(p) for p in pieces], pa.binary())]) if keep_ids else batch_of(names, columns)

    return over_shards(shards, decoded, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * keep_ids)


def token_counts(shards: DataFrame, tokens: Sequence[int]) -> DataFrame:
    """(token, occurrences, n_docs) over the corpus for the asked tokens, by rank; a row for each, with zeros too."""
    asked = sorted(set(tokens))

    def counted(base: int, shard: Shard):
        counts = [shard.count(t) for t in asked]
        docs = [len(np.unique(np.searchsorted(shard.starts, shard.places(t), side="right"))) if n else 0 for t, n in zip(asked, counts)]
        yield batch_of(["token", "n", "d"], [pa.array(asked, pa.int64()), pa.array(counts, pa.int64()), pa.array(docs, pa.int64())])

    found = over_shards(shards, counted, "token bigint, n bigint, d bigint")
    every = shards.sparkSession.createDataFrame([(t, 0, 0) for t in asked], "token bigint, n bigint, d bigint")
    return found.unionByName(every).groupBy("token").agg(F.sum("n").alias("occurrences"), F.sum("d").alias("n_docs"))


def occurrences(shards: DataFrame, tokens: Sequence[int]) -> DataFrame:
    """(token, doc_id, at, place) of each occurrence of the asked tokens, by select: `at` counts within the document, `place` over the corpus."""
    asked = sorted(set(tokens))

    def found(base: int, shard: Shard):
        for t in asked:
            places = shard.places(t)
            doc = np.searchsorted(shard.starts, places, side="right") - 1
            yield batch_of(["token", "doc_id", "at", "place"], [np.full(len(places), t, np.int64), doc_ids(shard.docs[doc]), places - shard.starts[doc], base + places])

    return over_shards(shards, found, "token bigint, doc_id bigint, at bigint, place bigint")


def tokens_at(shards: DataFrame, places: DataFrame) -> DataFrame:
    """(place, token) for each of the corpus places asked for (column `place`), by access; places beyond the corpus have none.

    Places are dealt to their shards by blocks of the corpus, so none is compared with all shards.
    """
    step = SHARD_IDS
    held = with_base(shards).select("base", "n_ids", "data")
    cells = held.withColumn("cell", F.explode(F.sequence(F.floor(F.col("base") / step), F.floor((F.col("base") + F.col("n_ids") - 1) / step)))).select("cell", "base", "n_ids")
    asked = places.select(F.col("place").cast("long").alias("place")).distinct().withColumn("cell", F.floor(F.col("place") / step))
    met = asked.join(cells, "cell").filter("place >= base AND place < base + n_ids").groupBy("base").agg(F.sort_array(F.collect_list("place")).alias("places"))

    def read(batches):
        for batch in batches:
            for base, at, data in zip(batch.column("base").to_pylist(), batch.column("places").to_pylist(), batch.column("data")):
                shard = Shard(data.as_buffer())
                yield batch_of(["place", "token"], [pa.array(at, pa.int64()), pa.array([shard.access(p - base) for p in at], pa.int64())])

    return map_batches(held.join(met, "base").select("base", "places", "data"), read, "place bigint, token bigint")

"""Merkle fixity audit of archived records.

Records are written to archives of a bounded number of records in the shared folder, each record a gzip member as in .warc.gz
files; an archive's ordered offset ranges (16 records each) are its stored pieces and the leaves of a hash tree of fan-out 16.
Each replica is read and hashed from its own stored pieces. Two replicas are compared by their roots; children are looked up
only below nodes that differ, and records are paired only in ranges that differ. All steps are joins and grouped hashes on narrow
rows, a node has at most 16 children, and an archive's place comes from the task that writes it, so no key is hot.

Nulls: a null payload is a record of an empty body, a null page_id or url is written as empty (the index keeps the null).
Repeated rows are records of their own. An empty table has no archives and no findings. Extra columns are ignored. A record that
one replica lacks is `missing` (or `extra`); one that differs is `corrupt`; one that is whole but not in its order is `moved`.
A record in another range is missing from its own and extra there. A member that can't be unpacked has the digest of its bytes.
A range that a replica stores more than once differs from one that is stored once: equal copies are paired first, then the others
in the order of their hashes; records of a copy that is left over are `extra` (of ours: `missing`).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import defaultdict
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, map_batches, materialize, shared_dir, slices

FAN_OUT_BITS, LEVELS = 4, 3
#: Records in a range, and in an archive: a full tree.
RANGE, ARCHIVE = 1 << FAN_OUT_BITS, 1 << (FAN_OUT_BITS * LEVELS)
GZIP = 31
#: A stored range: its records' gzip members one after the other, and their index.
STORED = "archive bigint, node bigint, offset bigint, page_ids array<bigint>, urls array<string>, sizes array<bigint>, data binary"
HASHED = "archive bigint, node bigint, hash string, records array<struct<page_id:bigint,url:string,offset:bigint,length:bigint,digest:binary>>"
FINDINGS = "page_id bigint, url string, archive bigint, offset bigint, length bigint, digest string, copy_digest string, status string"
RECORD = pa.struct([("page_id", pa.int64()), ("url", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.binary())])
ARROW = {
    STORED: pa.schema([("archive", pa.int64()), ("node", pa.int64()), ("offset", pa.int64()), ("page_ids", pa.list_(pa.int64())), ("urls", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())]),
    HASHED: pa.schema([("archive", pa.int64()), ("node", pa.int64()), ("hash", pa.string()), ("records", pa.list_(RECORD))]),
    FINDINGS: pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("archive", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("copy_digest", pa.string()), ("status", pa.string())]),
}


def rows_of(kind: str, rows: list[tuple]) -> pa.RecordBatch:
    schema = ARROW[kind]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def warc_record(page_id: int | None, url: str | None, body: bytes) -> bytes:
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def sound(record: bytes, url: str | None) -> bytes | None:
    return record


def decayed(record: bytes, url: str | None) -> bytes | None:
    """A replica on failing storage, for drills: of 256 equal classes of URLs, 4 lose a bit in the middle of the record, 2 the record."""
    kind = hashlib.sha256((url or "").encode()).digest()[0]
    if kind < 4:
        at = len(record) // 2
        return record[:at] + bytes([record[at] ^ 1]) + record[at + 1 :]
    return None if kind < 6 else record


def piece(archive: int, node: int, offset: int, records: list[tuple]) -> tuple:
    """A row of STORED from (page_id, url, record)."""
    members = [zlib.compress(r, 6, wbits=GZIP) for _, _, r in records]
    return archive, node, offset, [p for p, _, _ in records], [u for _, u, _ in records], [len(m) for m in members], b"".join(members)


def written(batches):
    """Rows of STORED from pages."""
    context = TaskContext.get()
    task, count, offset, held = context.partitionId() if context else 0, 0, 0, []

    def closed():
        nonlocal offset, held
        first = count - len(held)
        if first % ARCHIVE == 0:
            offset = 0
        row = piece((task << 32) + first // ARCHIVE, first % ARCHIVE >> FAN_OUT_BITS, offset, held)
        offset, held = offset + len(row[-1]), []
        return row

    for b in slices(batches, "html"):
        rows = []
        for page, url, html in zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "html"))):
            held.append((page, url, warc_record(page, url, (html or "").encode())))
            count += 1
            if len(held) == RANGE:
                rows.append(closed())
        if rows:
            yield rows_of(STORED, rows)
    if held:
        yield rows_of(STORED, [closed()])


def members(row: dict):
    """(page_id, url, offset, bytes) of each record of a stored range, as its own index cuts it; bytes beyond the index are a record too."""
    at, data = 0, row["data"] or b""
    for page, url, n in zip(row["page_ids"], row["urls"], row["sizes"]):
        yield page, url, row["offset"] + at, data[at : at + n]
        at += n
    if at < len(data):
        yield None, None, row["offset"] + at, data[at:]


def unpacked(member: bytes) -> bytes:
    """The record, or the stored bytes where they are no whole member any more."""
    try:
        return zlib.decompress(member, wbits=GZIP)
    except zlib.error:
        return member


def stored(ranges: DataFrame, label: str) -> DataFrame:
    """Ranges written to the shared folder as they are (members are packed already), read back from there."""
    path = f"{shared_dir(ranges.sparkSession)}/{label}-{uuid.uuid4().hex}"
    ranges.write.options(**{"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20)}).parquet(path)
    return ranges.sparkSession.read.schema(STORED).parquet(path)


def archives(pages: DataFrame) -> DataFrame:
    """The pages written to archives: the stored ranges."""
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return stored(map_batches(narrow, written, STORED), "archives")


def replicated(ours: DataFrame, replica) -> DataFrame:
    """A replica in files of its own, of what is read from our files; replica: what its storage makes of a record (None: lost)."""

    def run(batch):
        rows = []
        for row in batch.to_pylist():
            kept = [(p, u, r) for p, u, r in ((p, u, replica(unpacked(m), u)) for p, u, _, m in members(row)) if r is not None]
            rows.append(piece(row["archive"], row["node"], row["offset"], kept))
        return rows_of(STORED, rows)

    return stored(arrow_map(ours, run, STORED, "data"), "replica")


def archived(pages: DataFrame, replica=sound) -> tuple[DataFrame, DataFrame]:
    """The stored ranges of our archives and of a replica of them."""
    ours = archives(pages)
    return ours, replicated(ours, replica)


def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each stored range's hash, over the identities and digests of its records in order, and its records."""
    rows = []
    for row in batch.to_pylist():
        records, whole = [], hashlib.sha256()
        for page, url, offset, member in members(row):
            record = unpacked(member)
            digest = hashlib.sha256(record).digest()
            records.append((page, url, offset, len(record), digest))
            whole.update(repr((page, url)).encode("utf-8", "surrogatepass") + digest)
        rows.append((row["archive"], row["node"], whole.hexdigest(), [dict(zip(("page_id", "url", "offset", "length", "digest"), r)) for r in records]))
    return rows_of(HASHED, rows)


def tree(ranges: DataFrame) -> list[DataFrame]:
    """Nodes by level, from ranges to roots: (archive, node, hash). A child's place goes into its parent's hash, and how many copies of
    a range there are into the range's."""
    n, ends = F.count("*"), (F.min("hash"), F.max("hash"), F.bit_xor(F.xxhash64("hash")).cast("string"))
    levels = [ranges.groupBy("archive", "node").agg(F.when(n == 1, F.min("hash")).otherwise(F.sha2(F.concat_ws(":", n.cast("string"), *ends), 256)).alias("hash"))]
    for _ in range(LEVELS - 1):
        child = F.concat_ws(":", F.lpad(F.col("node").cast("string"), 6, "0"), "hash")
        below = levels[-1].withColumn("child", child).groupBy("archive", F.shiftright("node", FAN_OUT_BITS).alias("node"))
        levels.append(below.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("child")), ","), 256).alias("hash")))
    return levels


def differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Nodes whose hashes differ or which only one side has."""
    a, b = ours.withColumnRenamed("hash", "ours"), theirs.withColumnRenamed("hash", "theirs")
    return a.join(b, ["archive", "node"], "full").filter(~F.col("ours").eqNullSafe(F.col("theirs"))).select("archive", "node")


def under(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    marked = parents.select("archive", F.col("node").alias("parent"))
    return nodes.withColumn("parent", F.shiftright("node", FAN_OUT_BITS)).join(marked, ["archive", "parent"], "left_semi").drop("parent")


def findings(ours: list[dict], theirs: list[dict]):
    """(our record, their record, status) of the records of one range that differ: by order and digest, then digest, then identity."""
    left, right = list(range(len(ours))), list(range(len(theirs)))
    key = lambda r: (r["page_id"], r["url"], r["digest"])
    for block in SequenceMatcher(None, [key(r) for r in ours], [key(r) for r in theirs], autojunk=False).get_matching_blocks():
        left = [i for i in left if not block.a <= i < block.a + block.size]
        right = [j for j in right if not block.b <= j < block.b + block.size]
    for status, same in (("moved", key), ("corrupt", lambda r: (r["page_id"], r["url"])), ("corrupt", lambda r: r["digest"]), ("corrupt", lambda r: r["offset"])):
        free = defaultdict(list)
        for j in reversed(right):
            free[same(theirs[j])].append(j)
        for i in list(left):
            if free[same(ours[i])]:
                j = free[same(ours[i])].pop()
                left.remove(i)
                right.remove(j)
                yield ours[i], theirs[j], status
    yield from ((ours[i], None, "missing") for i in left)
    yield from ((None, theirs[j], "extra") for j in right)


def paired(batches):
    for b in batches:
        rows = []
        for r in b.to_pylist():
            for a, c, status in findings(r["ours"] or [], r["theirs"] or []):
                one = a or c
                rows.append((one["page_id"], one["url"], r["archive"], one["offset"], one["length"], a and a["digest"].hex(), c and c["digest"].hex(), status))
        if rows:
            yield rows_of(FINDINGS, rows)


def audit(ours: DataFrame | tuple[DataFrame, DataFrame], theirs: DataFrame | None = None) -> DataFrame:
    """The records that differ between two replicas' stored ranges: page_id, url, archive, offset, length, digest, copy_digest, status.

    The two may come as a pair. Offset and length are those in our archive, of an extra record those in theirs.
    """
    ours, theirs = ours if theirs is None else (ours, theirs)
    ours, theirs = (materialize(arrow_map(x, hashed, HASHED, "data"), f"ranges-{k}") for k, x in enumerate((ours, theirs)))
    a, b = tree(ours), tree(theirs)
    bad = differing(a[-1], b[-1])
    for level in range(LEVELS - 2, -1, -1):
        bad = differing(under(a[level], bad), under(b[level], bad))
    bad = materialize(bad, "differing")
    alike, copy = Window.partitionBy("archive", "node", "hash").orderBy(F.xxhash64("records")), Window.partitionBy("archive", "node").orderBy("hash", "k")
    sides = [x.join(bad, ["archive", "node"], "left_semi").withColumn("k", F.row_number().over(alike)) for x in (ours, theirs)]
    equal = ["archive", "node", "hash", "k"]
    left = [a.join(b.select(*equal), equal, "left_anti").withColumn("copy", F.row_number().over(copy)) for a, b in (sides, sides[::-1])]
    told = [x.select("archive", "node", "copy", F.col("records").alias(n)) for x, n in zip(left, ("ours", "theirs"))]
    return map_batches(told[0].join(told[1], ["archive", "node", "copy"], "full"), paired, FINDINGS)

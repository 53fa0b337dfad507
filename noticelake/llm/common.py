"""What the operators share: written tables that outlive executors, Arrow batches in bounded slices, words by ASCII white space."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Text bytes that one step of a vectorised function works on; bounds a Python worker's memory.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one if that is unset and the master is local."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "local-cluster" in spark.sparkContext.master:
        raise ValueError("spark.checkpoint.dir must be set for a local cluster")
    made = f"file://{tempfile.gettempdir()}/spark-shared-{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and a lost executor costs a re-read only."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Columns of documents that operators name.
NAMED = ("doc_id", "text", "source", "n_chars")


def sheltered(docs: DataFrame, fn: Callable[[DataFrame], DataFrame], named: Sequence[str] = NAMED) -> DataFrame:
    """fn(docs), which keeps the columns, with all but the named columns under other names meanwhile, so none can clash."""
    own = {c: c if c in named else f"__other{k}" for k, c in enumerate(docs.columns)}
    out = fn(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in own.items()])


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which null keys meet; right's key columns are dropped."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    met = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[f"__r_{k}"])
        met = one if met is None else met & one
    return left.join(renamed, met, how).drop(*[f"__r_{k}" for k in keys])


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


#: Bytes of a written table (compressed files) up to which it may be broadcast.
MOST_BROADCAST_BYTES = 8 << 20


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether df has at most so many rows; on written tables the count comes from the files' footers."""
    return df.count() <= most_rows


def file_bytes(written: DataFrame) -> int:
    """The size of a written table's files, as Spark's own statistics have it; nothing is read."""
    return int(str(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def looked_up(df: DataFrame, label: str, most_rows: int = 200_000) -> DataFrame:
    """df written and measured: marked for broadcast if neither its rows nor its files' bytes are above the limits, else left
    to a shuffled join."""
    kept = materialize(df, label)
    return F.broadcast(kept) if file_bytes(kept) <= MOST_BROADCAST_BYTES and small_enough(kept, most_rows) else kept


#: Identifier of rows without one: above all real ones, apart by text.
NO_ID = (1 << 63) - (1 << 40)


def with_keys(docs: DataFrame) -> DataFrame:
    """(id, k1, k2, text): id is doc_id, or a number above all of them; k1 and k2 tell texts apart; a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"))
    keyed = keyed.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text", F.length("text"))})
    return keyed.withColumn("id", F.coalesce("id", F.lit(NO_ID) + F.pmod("k1", F.lit(1 << 40))))


def distinct_texts(keyed: DataFrame, most_rows: int) -> tuple[DataFrame, DataFrame]:
    """Each text once, in the row with the smallest id; and (id, k1, first) for rows that repeat a text of a smaller id.

    Counts are summed on the map side, and lists of copies are broadcast only if counted to be short, so a text that a third of
    all rows hold is no burden.
    """
    texts = keyed.select("id", "k1", "k2")
    several = texts.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    met = texts.join(looked_up(several, "several", most_rows), ["k1", "k2"])
    copies = looked_up(met.filter("id > first").select("id", "k1", "first").distinct(), "copies", most_rows)
    single = keyed.join(copies.drop("first"), ["id", "k1"], "left_anti")
    again = looked_up(met.filter("id = first").groupBy("id", "k1").count().filter("count > 1").drop("count"), "again", most_rows)
    if not small_enough(again, 0):
        single = single.join(again, ["id", "k1"], "left_anti").unionByName(single.join(again, ["id", "k1"], "left_semi").dropDuplicates(["id", "k1"]))
    return single, copies


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column holds about `most` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_numpy(zero_copy_only=False).astype(np.float64))
        ends, start, total = np.cumsum(sizes), 0, batch.num_rows
        while start < total:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


#: What empties the tables that functions keep in a worker between tasks; any task of another function calls them.
HELD: list[Callable[[], None]] = []


def frugal() -> None:
    """Large blocks of a worker come from the system and go back to it, whatever was freed before (the allocator would else
    raise that limit as it goes and keep them)."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD; lower, and each array of a step would be mapped and zeroed anew
        libc.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD
        libc.mallopt(-8, 2)  # M_ARENA_MAX
    except (OSError, AttributeError):
        pass
    pa.set_memory_pool(pa.system_memory_pool())


def released(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn; at a task's end its worker gives freed memory back, as workers live on and share the executor's memory."""

    def run(batches):
        frugal()
        if not getattr(fn, "keeps_tables", False):
            for drop in HELD:
                drop()
        yield from fn(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass

    return run


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of a bounded number of rows and bytes."""
    if df.sparkSession.conf.get(BATCH_ROWS, "10000") == "10000":  # the default; long texts make such batches large
        df.sparkSession.conf.set(BATCH_ROWS, "1000")
    if df.sparkSession.conf.get(BATCH_BYTES, "64MB") in ("64MB", "67108864b"):  # the default; rows that hold lists are large
        df.sparkSession.conf.set(BATCH_BYTES, "8MB")
    return df.mapInArrow(released(fn), schema)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices of bounded size."""

    def run(batches):
        for piece in slices(batches, column, most):
            out = fn(piece)
            if out is not None and out.num_rows:
                yield out

    return map_batches(df, run, schema)


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """The texts with ASCII bytes mapped by table; nulls become empty."""
    texts = pc.fill_null(texts, "")
    if texts.type == pa.large_string():
        texts = texts.cast(pa.string())
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    changed = (data.to_pybytes() if data is not None else b"").translate(table)
    return pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(changed))


#: bytes.translate tables: A-Z to lower case; nothing changed.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SAME = bytes(range(256))


class Words:
    """The words of a slice of texts: ids into a dictionary of distinct words, flat, with offsets by text."""

    def __init__(self, texts: pa.Array, table: bytes = SAME):
        lists = pc.ascii_split_whitespace(translated(texts, table))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
        if not real.all():
            before = np.concatenate([[0], np.cumsum(real)])
            flat, offsets = flat.filter(pa.array(real)), before[offsets - offsets[0]]
        else:
            offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        self.offsets, self.ids, self.dictionary = offsets, coded.indices.to_numpy().astype(np.int64), coded.dictionary

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, in order."""
        table = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.dictionary.to_pylist()), np.uint64, len(self.dictionary))
        return table[self.ids] if len(table) else np.zeros(0, np.uint64)


MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words, by start; crosses document ends, so callers mask."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    for k in range(1, width):
        total = total * MUL + words[k : k + n]
    return mix(total)


def batch_of(schema_names: Sequence[str], arrays: Sequence[object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], list(schema_names))


def bucket_of(elements: np.ndarray, buckets: int) -> np.ndarray:
    return ((elements >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def blobs(bucket: np.ndarray, *columns: np.ndarray):
    """(bucket, bytes of each column) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    stops = np.append(starts[1:], len(bucket))
    return bucket[starts], [[c[a:b].tobytes() for a, b in zip(starts, stops)] for c in columns]


def by_bucket(batches, names):
    """(bucket, arrays of bytes joined) from rows sorted by bucket."""
    at, held = None, [[] for _ in names]
    for b in batches:
        for bucket, *values in zip(b.column("bucket").to_pylist(), *(b.column(n).to_pylist() for n in names)):
            if bucket != at:
                if at is not None:
                    yield at, [b"".join(h) for h in held]
                at, held = bucket, [[] for _ in names]
            for h, v in zip(held, values):
                h.append(v)
    if at is not None:
        yield at, [b"".join(h) for h in held]


#: Text bytes whose fingerprints one bucket should hold.
BUCKET_BYTES = 4 << 20


def buckets_for(docs: DataFrame, text: str = "text") -> int:
    """Buckets for fingerprints of the texts, by their bytes (counted), and several for each shuffle partition."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))

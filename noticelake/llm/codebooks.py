"""Codes of vectors from one codebook for each part, learnt by Lloyd's rounds with Elkan's bounds.

Components become whole numbers (a multiple, floored), vectors are cut into equal parts, and each part position has its own
codebook. For each part of each vector a row keeps its entry, an upper bound of the distance to that entry and a lower bound of
the distance to every entry. After a round the bounds move by as much as the entries moved. An entry is left out where the upper
bound is strictly below its lower bound, or strictly below half its distance from the part's own entry; the others are compared
in whole numbers, so ties are found and go to the lower index. Bounds are rounded outwards, so they stay bounds.

The rows with their bounds are written after each round, and the table of the round before is deleted. What comes to the driver
are the codebooks: `entries` x components sums. A sum goes through the cluster in pieces of 40 bits, so it is exact.

Rows whose vector is null or empty, or holds null or non-finite components, leave; so do those whose length differs from that of
the smallest vec_id that stays. The first entries are those of the smallest vec_ids (null last; equal ones by their vectors), as
many as there are if there are fewer. A length that `parts` doesn't divide gives parts that differ by one. Rows that share a
vec_id are coded each. Whole numbers of any size are compared exactly; an error beyond 64 bits is null, and
with it its label's. An empty table gives an empty result. A missing label column counts as null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, join_on, looked_up, map_batches, materialize

#: Whole numbers below this are computed with in 64 bits, others as Python's integers.
SMALL = 1 << 26
#: By how much bounds are widened, above the rounding of 32-bit floats.
GUARD = 1e-6
LARGEST = 3e38
LIMB = 40


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), in 64 bits if all are small."""
    scaled = np.floor(scale * x.astype(np.float64)) if not x.size or np.abs(x).max() < 2.0**50 else None
    if scaled is not None and (not x.size or np.abs(scaled).max() < SMALL):
        return scaled.astype(np.int64)
    exact = [int(y) * scale if abs(y) >= 2.0**52 else math.floor(scale * y) for y in x.astype(np.float64).ravel().tolist()]
    return np.array([*exact, None], object)[:-1].reshape(x.shape)


def bounds_of(parts: int, length: int) -> list[tuple[int, int]]:
    return [(p * length // parts, (p + 1) * length // parts) for p in range(parts)]


def rooted(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def raised(x: np.ndarray) -> np.ndarray:
    return x * (1 + GUARD)


def lowered(x: np.ndarray) -> np.ndarray:
    return np.minimum(x * (1 - GUARD), LARGEST)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(axis=-1)


class Book:
    """A part's entries: `wide` if they need Python's integers."""

    def __init__(self, entries: list[list[int]]):
        self.rows = entries
        most = max((abs(v) for row in entries for v in row), default=0)
        self.c = np.array(entries, np.int64) if most < SMALL else np.array([[*row, None] for row in entries], object)[:, :-1]
        between = np.array([[sum((a - b) ** 2 for a, b in zip(x, y)) for y in entries] for x in entries], object)
        self.half = lowered(rooted(between) / 2) if len(entries) else np.zeros((0, 0))

    def moved_from(self, old: "Book") -> np.ndarray:
        return raised(np.array([math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))) for x, y in zip(old.rows, self.rows)]))


def fitted(x: np.ndarray, book: Book) -> np.ndarray:
    """x in the number type that the book needs."""
    return x.astype(object) if book.c.dtype == object and x.dtype != object else x


def first_assigned(x: np.ndarray, book: Book):
    """Entry, its squared distance, upper and lower bounds, by measuring all."""
    d2 = squared(fitted(x, book)[:, None, :], book.c[None])
    a = d2.argmin(axis=1)
    own, roots = d2[np.arange(len(x)), a], rooted(d2)
    return a, own, raised(roots[np.arange(len(x)), a]), lowered(roots), d2.size


def assigned(x: np.ndarray, book: Book, a: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """Entry, upper and lower bounds with the book's new entries, from bounds that already moved; and how many distances were measured."""
    x, every = fitted(x, book), np.arange(len(book.rows))

    def open_pairs(a, upper, lower):
        return ~((upper[:, None] < lower) | (upper[:, None] < book.half[a])) & (every != a[:, None])

    rows = np.flatnonzero(open_pairs(a, upper, lower).any(axis=1))
    if not len(rows):
        return a, upper, lower, 0
    mine, own = a[rows], squared(x[rows], book.c[a[rows]])
    tight = raised(rooted(own))
    lower[rows, mine] = lowered(rooted(own))
    at, entry = np.nonzero(open_pairs(mine, tight, lower[rows]))
    d2 = squared(x[rows[at]], book.c[entry])
    lower[rows[at], entry] = lowered(rooted(d2))
    largest = max([*d2.tolist(), *own.tolist()]) + 1
    table = np.full((len(rows), len(every)), largest, d2.dtype if d2.dtype == object else np.int64)
    table[np.arange(len(rows)), mine] = own
    table[at, entry] = d2
    best = table.argmin(axis=1)  # the first of equal ones
    a[rows], upper[rows] = best, raised(rooted(table[np.arange(len(rows)), best]))
    return a, upper, lower, len(rows) + len(at)


def components(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def rounds(books: list[Book], moved: list[np.ndarray] | None, spans: list[tuple[int, int]], scale: int):
    """A function that assigns the rows of batches; without `moved` they have no bounds yet. `measured` counts distances."""
    k, length = len(books[0].rows), spans[-1][1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v, n = whole_numbers(components(batch, length), scale), batch.num_rows
            if moved is not None:
                codes, upper, lower = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in (("codes", np.uint8), ("upper", "<f4"), ("lower", "<f4")))
                codes, upper, lower = codes.reshape(n, -1), upper.reshape(n, -1).astype(np.float64), lower.reshape(n, -1, k).astype(np.float64)
            out_codes, out_upper, out_lower = np.zeros((n, len(spans)), np.uint8), np.zeros((n, len(spans)), "<f4"), np.zeros((n, len(spans), k), "<f4")
            measured = np.zeros(n, np.int64)
            for p, ((lo, hi), book) in enumerate(zip(spans, books)):
                if moved is None:
                    a, _, u, low, m = first_assigned(v[:, lo:hi], book)
                else:
                    a = codes[:, p].astype(np.int64)
                    u, low = raised(upper[:, p] + moved[p][a]), lowered(np.maximum(lower[:, p] - moved[p], 0))
                    a, u, low, m = assigned(v[:, lo:hi], book, a, u, low)
                out_codes[:, p], out_upper[:, p], out_lower[:, p] = a, np.minimum(raised(u), np.inf), lowered(low)
                measured[0] += m
            binary = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (out_codes, out_upper, out_lower)]
            yield batch_of(["vec_id", "label", "x", "codes", "upper", "lower", "measured"], [batch.column("vec_id"), batch.column("label"), batch.column("x"), *binary, measured])

    return run


def limbs(value: int):
    """(k, piece) with value = the sum of piece * 2**(40 k); only the last may be negative."""
    k = 0
    while not -(1 << LIMB) < value < 1 << LIMB:
        yield k, value & ((1 << LIMB) - 1)
        k, value = k + 1, value >> LIMB
    if value:
        yield k, value


def summing(spans: list[tuple[int, int]], entries: int, scale: int):
    """Sums of components and counts by entry, for a task: (cell, limb, value); a cell is an entry and a component, or an entry
    and a part (its count)."""
    length, wide = spans[-1][1], spans[-1][1] + len(spans)

    def run(batches):
        total = np.zeros((entries, wide), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = whole_numbers(components(batch, length), scale)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(v), -1).astype(np.int64)
            for p, (lo, hi) in enumerate(spans):
                total[:, length + p] += np.bincount(codes[:, p], minlength=entries).astype(object)
                for j in range(lo, hi):
                    if v.dtype == object:
                        np.add.at(total[:, j], codes[:, p], v[:, j])
                    else:  # below 2**26 each: exact in floating point over a batch
                        total[:, j] += np.bincount(codes[:, p], v[:, j], minlength=entries).astype(np.int64).astype(object)
        rows = [(e * wide + j, k, piece) for e in range(entries) for j in range(wide) for k, piece in limbs(int(total[e, j]))]
        if rows:
            yield batch_of(["cell", "limb", "value"], [pa.array(c, pa.int64()) for c in zip(*rows)])

    return run


def updated(state: DataFrame, books: list[Book], spans: list[tuple[int, int]], scale: int) -> list[Book]:
    """Books whose used entries are their parts' floored means."""
    entries, length, wide = len(books[0].rows), spans[-1][1], spans[-1][1] + len(spans)
    sums = map_batches(state.select("x", "codes"), summing(spans, entries, scale), "cell bigint, limb bigint, value bigint")
    total = [0] * (entries * wide)
    for r in sums.groupBy("cell", "limb").agg(F.sum("value").alias("value")).collect():  # at most entries x components cells
        total[r["cell"]] += r["value"] << (LIMB * r["limb"])
    made = []
    for p, ((lo, hi), book) in enumerate(zip(spans, books)):
        counts = [total[e * wide + length + p] for e in range(entries)]
        made.append(Book([[total[e * wide + j] // n for j in range(lo, hi)] if n else book.rows[e] for e, n in enumerate(counts)]))
    return made


def coder(books: list[Book], spans: list[tuple[int, int]], scale: int, moved: list[np.ndarray]):
    """The last assignment, from the bounds, and the exact squared distances to the entries."""
    assign, length = rounds(books, moved, spans, scale), spans[-1][1]

    def run(batches):
        for batch in assign(batches):
            v, codes = whole_numbers(components(batch, length), scale), batch.column("codes").to_pylist()
            of = np.frombuffer(b"".join(codes), np.uint8).reshape(len(v), -1)
            error = [0] * len(v)
            for p, ((lo, hi), book) in enumerate(zip(spans, books)):
                error = [e + int(d) for e, d in zip(error, squared(fitted(v[:, lo:hi], book), book.c[of[:, p]]))]
            error = pa.array([e if e < 1 << 63 else None for e in error], pa.int64())
            yield batch_of(["vec_id", "label", "code", "error"], [batch.column("vec_id"), batch.column("label"), [c.hex() for c in codes], error])

    return run


def forget(written: DataFrame) -> None:
    """Deletes a table that `materialize` wrote and nothing reads any more."""
    jvm, conf = written.sparkSession._jvm, written.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, x) of the rows that take part."""
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col(vector).alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return named.filter(F.col("x").isNotNull() & (F.size("x") > 0) & ~bad)


def train(vectors: DataFrame, parts: int = 8, entries: int = 16, n_rounds: int = 6, scale: int = 4096, vector: str = "embedding"):
    """(state, books, moved, spans): the written rows with entries and bounds after the rounds, the final books, how far their
    entries moved last. None if no row takes part. `measured` in the state sums to the distances measured in its round."""
    kept = usable(vectors, vector)
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    lead = kept.orderBy(*order).select(F.size("x").alias("n")).first()
    if lead is None:
        return None
    spans, kept = bounds_of(parts, lead["n"]), kept.filter(F.size("x") == lead["n"])
    first = [whole_numbers(np.array(r["x"]), scale).tolist() for r in kept.orderBy(*order).select("x").limit(entries).collect()]
    books, moved, state = [Book([row[lo:hi] for row in first]) for lo, hi in spans], None, kept
    label, x = kept.schema["label"].dataType.simpleString(), kept.schema["x"].dataType.simpleString()
    schema = f"vec_id bigint, label {label}, x {x}, codes binary, upper binary, lower binary, measured bigint"
    for turn in range(n_rounds):
        last, state = state, materialize(map_batches(state, rounds(books, moved, spans, scale), schema), "bounds")
        if turn:
            forget(last)
        old, books = books, updated(state, books, spans, scale)
        moved = [b.moved_from(o) for b, o in zip(books, old)]
    return state, books, moved, spans


def books_digest(books: list[Book]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for row in b.rows for v in row).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, n_rounds: int = 6, scale: int = 4096, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of each row that takes part."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    if n_rounds < 1:
        raise ValueError("at least one round")
    trained = train(vectors, parts, entries, n_rounds, scale, vector)
    label = dict(usable(vectors, vector).dtypes)["label"]
    if trained is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id bigint, label {label}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    state, books, moved, spans = trained
    coded = materialize(map_batches(state, coder(books, spans, scale, moved), f"vec_id bigint, label {label}, code string, error bigint"), "codes")
    forget(state)
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint")
    by_label = coded.groupBy("label").agg(F.when(F.count("error") == F.count("*"), total).alias("label_error"))
    met = join_on(coded, looked_up(by_label, "label-errors"), ["label"], "left")
    return met.select("vec_id", "label", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))

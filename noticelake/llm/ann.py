"""Nearest neighbours by largest inner product over shifted space-filling curves.

Vectors are projected on a few random directions, several times, each time with another shift; a projection's cells are put
in order by a Hilbert curve. Spark range-partitions each ordering; in it a run of `window` neighbours is searched, with half a
window before and after it, for the queries among them; so neighbouring windows overlap. The curves' findings are merged and
reranked. On vectors with structure that is nearly all; on others (isotropic noise in many dimensions) no such ordering finds
enough, so a second pass makes the result whole: vectors in runs of one ordering, and queries in such runs, each run with centre
and radius, and groups of runs with theirs: a tree of three levels on either side. Groups are paired first, then the runs below
pairs of groups that stay: a pair stays where its bound (the largest product that a query and a vector of the two can have)
reaches the least that one of its queries has found. Query runs are dealt to parts; a run of vectors goes once to each part that
has a query run it is paired with, and is searched for the queries whose own bound reaches what they have by then. The result
is exact.

Inner products are sums of products of doubles from the first component to the last; a faster product only preselects, with a
margin above its rounding. Vectors of other lengths than the query's are no candidates for it.

Nulls: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without vec_id.
Ties go to the smaller vec_id. Of rows that share a vec_id the smallest vector (by components in order) stands for all. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, looked_up, map_batches, materialize, small_enough

MARGIN = 1e-9
#: Parts that blocks of queries are dealt to at most.
MOST_PARTS = 4096
#: Blocks of a group.
FAN = 32
#: Tasks for each shuffle partition that parts of queries, times salts of vectors, should come to.
SPREAD = 4
BLOCKS = "block string, grp string, dim int, ids binary, vectors binary, centre binary, radius double, norm double, least binary, floor double"
GROUPS = "grp string, dim int, centre binary, radius double, norm double, floor double"
FOUND = "query_id bigint, vec_id bigint, score double"


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell coordinates (0 .. 2^bits - 1), by Skilling's transposition."""
    x = cells.T.astype(np.uint64).copy()
    n, one = len(x), np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        p, qq = np.uint64(q - 1), np.uint64(q)
        for i in range(n):
            set_ = (x[i] & qq) != 0
            flip = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ flip)
            if i:
                x[i] ^= flip
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & np.uint64(q)) != 0, t ^ np.uint64(q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.view(np.int64)


def keyer(curves: int, axes: int, bits: int, spread: float, seed: int):
    def run(batches):
        for b in batches:
            sizes = np.asarray(b.column("dim"))
            flat = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            keys = np.zeros((curves, len(sizes)), np.int64)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x = flat[(starts[rows][:, None] + np.arange(dim)).ravel()].reshape(len(rows), dim)
                for c in range(curves):
                    rng = np.random.default_rng([seed, int(dim), c])
                    way = rng.standard_normal((dim, axes))
                    y = x @ way / spread + rng.uniform(-0.5, 0.5, axes)
                    cells = np.clip((y + 4) / 8 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
                    keys[c, rows] = hilbert_key(cells, bits)
            for c in range(curves):
                yield batch_of(["curve", "key", "vec_id", "dim", "embedding", "asks"], [pa.array(np.full(len(sizes), c, np.int32)), keys[c], b.column("vec_id"), b.column("dim"), b.column("embedding"), b.column("asks")])

    return run


def runs(batches, names: list[str]):
    """(head, ids, vectors, further columns): parts of sorted batches in which curve and length are the same."""
    for b in batches:
        heads = np.column_stack([np.asarray(b.column(n), np.int64) for n in ("curve", "dim")])
        bounds = np.concatenate([[0], np.flatnonzero((heads[1:] != heads[:-1]).any(axis=1)) + 1, [len(heads)]])
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if high > low:
                part = b.slice(low, high - low)
                vectors = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(high - low, -1)
                yield tuple(heads[low].tolist()), np.asarray(part.column("vec_id"), np.int64), vectors, [part.column(n).to_numpy(zero_copy_only=False) for n in names]


def windowed(window: int, k: int):
    """What the queries of each window find in it and in half a window before and after."""
    half = window // 2

    def run(batches):
        head, held, done = None, None, 0

        def searched(stop: int):
            ids, x, asks = held
            core, near = slice(done, stop), slice(max(0, done - half), stop + half)
            own = np.flatnonzero(asks[core]) + done
            return best(ids[own], x[own].astype(np.float64), np.full(len(own), -np.inf), ids[near], x[near].astype(np.float64), k)

        for now, ids, x, (asks,) in runs(batches, ["asks"]):
            if now != head:
                if held is not None and (rows := searched(len(held[0]))):
                    yield _found(rows)
                head, held, done = now, (ids, x, asks), 0
            else:
                held = tuple(np.concatenate(p) for p in zip(held, (ids, x, asks)))
            while len(held[0]) - done >= window + half:
                if rows := searched(done + window):
                    yield _found(rows)
                done += window
                spare = max(0, done - half)
                held, done = tuple(h[spare:] for h in held), done - spare
        if held is not None and (rows := searched(len(held[0]))):
            yield _found(rows)

    return run


def blocker(window: int):
    """Cuts a sorted partition into blocks of at most `window` vectors of one length, each with its centre, radius and largest norm,
    and with what its vectors have found so far (nothing, if they are no queries)."""

    def run(batches):
        context, count = TaskContext.get(), 0
        task = context.partitionId() if context else 0
        for (_, dim), ids, x, (least,) in runs(batches, ["least"]):
            for low in range(0, len(ids), window):
                part = slice(low, low + window)
                y, floor = x[part].astype(np.float64), np.where(np.isnan(least[part].astype(np.float64)), -np.inf, least[part].astype(np.float64))
                centre = y.mean(axis=0)
                radius, norm = np.sqrt(((y - centre) ** 2).sum(axis=1).max()), np.sqrt((y * y).sum(axis=1).max())
                count += 1
                values = (f"{task}-{count}", f"{task}-{dim}-{count // FAN}", dim, ids[part].tobytes(), x[part].tobytes(), centre.tobytes(), float(radius), float(norm), floor.tobytes(), float(floor.min()))
                kinds = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.binary(), pa.float64()]
                yield batch_of([f.split()[0] for f in BLOCKS.split(", ")], [pa.array([v], t) for v, t in zip(values, kinds)])

    return run


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = np.zeros(len(y))
    for d in range(y.shape[1]):
        total += x[d] * y[:, d]
    return total


def best(query_ids, queries, least, ids, vectors, k):
    """(query_id, vec_id, score) of each query's k best among the vectors, if not below its least score."""
    out = []
    if not len(query_ids):
        return out
    for low in range(0, len(query_ids), 512):
        part = slice(low, low + 512)
        fast = queries[part] @ vectors.T
        fast[query_ids[part][:, None] == ids[None, :]] = -np.inf
        room = MARGIN * (1 + np.abs(queries[part]).sum(axis=1) * np.abs(vectors).max())
        floor = least[part] - room
        if len(ids) > k:
            floor = np.maximum(floor, np.partition(fast, len(ids) - k, axis=1)[:, len(ids) - k] - room)
        for i, q in enumerate(range(low, min(low + 512, len(query_ids)))):
            near = np.flatnonzero((fast[i] >= floor[i]) & np.isfinite(fast[i]))
            if len(near):
                score = exact_products(queries[q], vectors[near])
                for j in np.lexsort((ids[near], -score))[:k]:
                    out.append((int(query_ids[q]), int(ids[near[j]]), float(score[j])))
    return out


def _found(rows):
    return batch_of(["query_id", "vec_id", "score"], [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))])


def summed_up(blocks: pa.Table) -> pa.Table:
    """A group of blocks (at most FAN) as one: a ball that holds theirs."""
    centres = np.stack([np.frombuffer(c) for c in blocks.column("centre").to_pylist()])
    centre = centres.mean(axis=0)
    away = np.sqrt(((centres - centre) ** 2).sum(axis=1)) * (1 + MARGIN)
    of = lambda n: blocks.column(n).to_numpy()
    values = (blocks.column("grp")[0].as_py(), blocks.column("dim")[0].as_py(), centre.tobytes(), float((away + of("radius")).max()), float(of("norm").max()), float(of("floor").min()))
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.float64()]
    return pa.table([pa.array([v], t) for v, t in zip(values, kinds)], names=[f.split()[0] for f in GROUPS.split(", ")])


def groups_of(blocks: DataFrame) -> DataFrame:
    return blocks.select("grp", "dim", "centre", "radius", "norm", "floor").groupBy("grp").applyInArrow(summed_up, GROUPS)


def reaching(one: str, other: str):
    """Pairs (one, other) of vectors and queries that may hold a product as large as the least that one of the queries has found."""

    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                c, q = (np.frombuffer(b"".join(part.column(n).to_pylist())).reshape(-1, dim) for n in ("centre", "q_centre"))
                radius, norm, q_radius, q_norm, floor = (part.column(n).to_numpy() for n in ("radius", "norm", "q_radius", "q_norm", "q_floor"))
                long, q_long = (np.sqrt((x * x).sum(axis=1)) for x in (c, q))
                most = np.minimum((c * q).sum(axis=1) + long * q_radius + radius * (q_long + q_radius), norm * q_norm)
                stays = pa.array(most + np.abs(most) * MARGIN + MARGIN >= floor)
                yield batch_of([one, other], [part.column(n).filter(stays) for n in (one, other)])

    return run


SIDE = "part int, salt int, vectors boolean, asking string, askings array<string>, dim int, ids binary, x binary, centre binary, radius double, least binary"


class Asking:
    """A block of queries with the best each has found: at most k, and the least that counts."""

    def __init__(self, ids, x, least, k):
        self.ids, self.x, self.least, self.k = ids, x, least.copy(), k
        self.norm, self.row, self.found = np.sqrt((x * x).sum(axis=1)), {int(i): n for n, i in enumerate(ids)}, [[] for _ in ids]

    def meet(self, ids, x, centre, radius) -> None:
        bound = self.x @ centre + self.norm * radius
        reach = np.flatnonzero(bound + np.abs(bound) * MARGIN + MARGIN >= self.least)
        changed = set()
        for query, vec, score in best(self.ids[reach], self.x[reach], self.least[reach], ids, x, self.k):
            n = self.row[query]
            self.found[n].append((-score, vec))
            changed.add(n)
        for n in changed:
            self.found[n] = sorted(self.found[n])[: self.k]
            if len(self.found[n]) == self.k:
                self.least[n] = max(self.least[n], -self.found[n][-1][0])

    def rows(self):
        return [(int(i), vec, -score) for i, found in zip(self.ids, self.found) for score, vec in found]


def across(k: int, kind: str):
    """What the queries of each part find in the blocks of vectors that are sent to it, one block after the other."""

    def run(batches):
        at, held = None, {}

        def closed():
            for asking in held.values():
                if rows := asking.rows():
                    yield _found(rows)
            held.clear()

        for b in batches:
            for r in b.to_pylist():
                if (r["part"], r["salt"]) != at:
                    yield from closed()
                    at = (r["part"], r["salt"])
                ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["x"], kind).astype(np.float64).reshape(-1, r["dim"])
                if r["vectors"]:
                    for name in r["askings"]:
                        held[name].meet(ids, x, np.frombuffer(r["centre"]), r["radius"])
                else:
                    held[r["asking"]] = Asking(ids, x, np.frombuffer(r["least"]), k)
        yield from closed()

    return run


def ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order))


def paired(blocks: DataFrame, asking: DataFrame) -> DataFrame:
    """(block, asking): the pairs of blocks that may hold a neighbour. Only groups of blocks, one row for some FAN * window vectors
    and one for as many queries, meet without a key but their length; blocks meet through the groups that stay."""
    told = ("centre", "radius", "norm", "floor")
    groups = materialize(groups_of(blocks), "groups")
    q_blocks = asking.select("dim", F.col("q_grp").alias("grp"), *[F.col(f"q_{c}").alias(c) for c in told])
    q_groups = materialize(groups_of(q_blocks).select(F.col("grp").alias("q_grp"), "dim", *[F.col(c).alias(f"q_{c}") for c in told]), "query-groups")
    parts = max(1, min(q_groups.count(), MOST_PARTS))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    dealt = q_groups.withColumn("part", F.pmod(F.xxhash64("q_grp"), F.lit(parts)).cast("int"))
    near = map_batches(groups.select("*", everywhere).join(looked_up(dealt, "told"), ["part", "dim"]), reaching("grp", "q_grp"), "grp string, q_grp string")
    below = near.join(blocks.select("grp", "block", "dim", "centre", "radius", "norm"), "grp")
    below = below.join(asking.select("q_grp", "asking", *[f"q_{c}" for c in told]), "q_grp")
    return map_batches(below, reaching("block", "asking"), "block string, asking string")


def nearest(vectors: DataFrame, asks, k: int = 20, curves: int = 4, axes: int = 6, bits: int = 10, window: int = 1024, query_block: int = 1024, seed: int = 11, whole: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row for which the condition `asks` holds, among all other rows.

    With whole=False, what the curves' windows find, without the second pass.
    """
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind, element = ("<f4", "float") if single else ("<f8", "double")
    numbers = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & (F.size(numbers) > 0) & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(numbers, lambda x: x != 0)
    rows = vectors.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("embedding"), F.size(numbers).alias("dim"), asks.alias("asks"))
    twice = looked_up(rows.groupBy("vec_id").count().filter("count > 1").select("vec_id"), "twice")
    if not small_enough(twice, 0):
        least = F.min(F.struct("embedding", "dim", "asks")).alias("row")
        one = rows.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(least).select("vec_id", "row.*")
        rows = rows.join(twice, "vec_id", "left_anti").unionByName(one)
    norm = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    spread = math.sqrt(rows.agg(F.avg(norm)).first()[0] or 1.0)
    key = ["curve", "dim", "key", "vec_id"]
    keyed = lambda df, n: map_batches(df, keyer(n, axes, bits, spread, seed), f"curve int, key bigint, vec_id bigint, dim int, embedding array<{element}>, asks boolean")
    ordered = lambda df: df.repartitionByRange(*key).sortWithinPartitions(*key)
    first = materialize(ranked(map_batches(ordered(keyed(rows, curves)), windowed(window, k), FOUND)).filter(F.col("rank") <= k), "windows")
    if not whole:
        return first.select("query_id", "rank", "vec_id", "score")

    none = F.lit(None).cast("double")
    blocks = materialize(map_batches(ordered(keyed(rows, 1)).withColumn("least", none), blocker(window), BLOCKS), "blocks")
    reached = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    asking = keyed(rows.filter("asks"), 1).join(reached, "vec_id", "left")
    asking = materialize(map_batches(ordered(asking), blocker(query_block), BLOCKS).select(F.col("block").alias("asking"), "dim", *[F.col(c).alias(f"q_{c}") for c in ("grp", "ids", "vectors", "centre", "radius", "norm", "least", "floor")]), "queries")
    pairs = materialize(paired(blocks, asking), "pairs")
    parts = max(1, min(asking.count(), MOST_PARTS))
    salts = max(1, -(-SPREAD * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // parts))
    own, salt = F.pmod(F.xxhash64("asking"), F.lit(parts)).cast("int"), F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")
    sent = pairs.groupBy("block", own.alias("part")).agg(F.collect_list("asking").alias("askings"))  # the blocks of a part, at most
    null = lambda c: F.lit(None).cast(c)
    ours = blocks.join(sent, "block").select("part", salt.alias("salt"), F.lit(True).alias("vectors"), null("string").alias("asking"), "askings", "dim", "ids", F.col("vectors").alias("x"), "centre", "radius", null("binary").alias("least"))
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    theirs = asking.select(own.alias("part"), every_salt, F.lit(False).alias("vectors"), "asking", null("array<string>").alias("askings"), "dim", F.col("q_ids").alias("ids"), F.col("q_vectors").alias("x"), null("binary").alias("centre"), null("double").alias("radius"), F.col("q_least").alias("least"))
    dealt = ours.unionByName(theirs).repartition("part", "salt").sortWithinPartitions("part", "salt", "vectors")
    rest = map_batches(dealt, across(k, kind), FOUND)
    return ranked(first.select("query_id", "vec_id", "score").unionByName(rest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

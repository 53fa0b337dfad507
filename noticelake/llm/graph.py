"""Connected components of links between documents, by alternating large-star and small-star steps on written edge tables.

Once no more than `ONE_TASK` edges are left (counted), one task contracts them, which spares the further rounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_batches, materialize, small_enough

#: Edges that one task contracts by itself (16 bytes each); more take the distributed steps.
ONE_TASK = 500_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the least node of each one's component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new[x], new[y]) and np.array_equal(new, label):
            return nodes, nodes[new]
        label = new


def contracted(batches):
    """The edges of a partition as stars around least nodes, in bounded chunks."""
    held_a, held_b, size = [], [], 0

    def stars():
        nodes, least = roots(np.concatenate(held_a), np.concatenate(held_b))
        away = nodes != least
        return nodes[away], least[away]

    for batch in batches:
        a, b = (batch.column(n).to_numpy() for n in ("a", "b"))
        held_a.append(a)
        held_b.append(b)
        size += len(a)
        if size > 1_000_000:
            a, b = stars()
            held_a, held_b, size = [a], [b], len(a)
            if size > 500_000:
                yield batch_of(["a", "b"], [a, b])
                held_a, held_b, size = [], [], 0
    if size:
        yield batch_of(["a", "b"], list(stars()))


def solved(batches):
    """All edges, bounded in number, as stars around least nodes."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if parts:
        nodes, least = roots(*(np.concatenate(x) for x in zip(*parts)))
        away = nodes != least
        for low in range(0, int(away.sum()), 100_000):
            yield batch_of(["a", "b"], [nodes[away][low : low + 100_000], least[away][low : low + 100_000]])


def contract(edges: DataFrame) -> DataFrame:
    return map_batches(edges.select("a", "b"), contracted, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b): component is the least node that it reaches."""
    turned = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(contract(turned).distinct(), "edges")
    print_ = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    state = print_(now)
    while state[0]:
        if small_enough(now, ONE_TASK):
            now = materialize(map_batches(now.coalesce(1), solved, "a bigint, b bigint"), "edges")
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()
        large = materialize(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
        if (new := print_(after)) == state:
            break
        now, state = after, new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

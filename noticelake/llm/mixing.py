"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of the mix by weight, but no more than max_ratio times its size; what is above is shared anew
by weight until no target is above (found in closed form: sources in order of the level at which they are full). Each document
then has the whole part of target / size of its source as certain copies. What is then missing is drawn with unequal
probabilities: a document's chance p is in proportion to `favour` powers of its size (by classes of sizes, each up to twice the
one before), at most 1, and such that the chances times the sizes come to what is missing; a chance of 1 is a certain copy more.
Documents are ranked by (u / (1-u)) / (p / (1-p)), u a random number from a hash of seed and document, and the first are taken
until the source's words are reached; the last place goes to the document whose size comes nearest to what is then missing, if
that brings the source nearer to its target. A copied row counts as a document of its own.

The ranking is never gathered by source: ranks are cut into buckets whose words are summed by (source, bucket); only the
bucket in which the target is reached is ordered exactly. A source with a third of all rows is thus spread evenly.

Nulls: a null text has no words and is never taken beyond 0 words; null sources are one source, last in order; a null doc_id
is hashed as such. Each row has a random number of its own: rows that share id, source and text are told apart by numbers 0, 1,
2, ..., dealt by counting them by partition, so the numbers of equal rows are the same however the input is split. Ties of rank
go by doc_id, size, then place in the input. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, arrow_map, batch_of, join_on, looked_up, materialize, small_enough

BUCKETS = 4096
#: A probability below this is none.
NONE = 1e-12


def sized(batch: pa.RecordBatch) -> pa.RecordBatch:
    kept = ["doc_id", "source", "text_key", "draw"]
    return batch_of([*kept, "size"], [*[batch.column(c) for c in kept], Words(batch.column("text")).counts])


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), total_ratio: float = 1.5, max_ratio: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): one row for each source, however many documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_ratio)
        .withColumns({"total": F.sum("source_size").over(every) * total_ratio, "all_weight": F.sum("weight").over(every)})
        .withColumns({"cap_before": F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "weight_left": F.col("all_weight") - F.coalesce(F.sum("weight").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
        .withColumns({"level": (F.col("total") - F.col("cap_before")) / F.col("weight_left"), "turn": F.row_number().over(fill)})
        .withColumn("level", F.min(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct("turn", "level"))).over(every)["level"])
        .select("source", "source_size", "weight", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap")).alias("target"))
    )


def size_class(size: Column) -> Column:
    """Binary digits of a size."""
    return F.length(F.bin(size))


def inclusion(by_class: DataFrame, targets: DataFrame, favour: float) -> DataFrame:
    """(source, class, source_size, target, certain, p, missing) from the words of each source and size class and the targets.

    Classes of the largest sizes are full (p = 1) as long as the rest, at p in proportion to size ** favour, could not hold what is
    missing; `missing` is what the draw is to reach.
    """
    of, down = Window.partitionBy("source"), Window.partitionBy("source").orderBy(F.col("class").desc())
    size, f = F.col("source_size"), F.pow(F.lit(2.0), F.col("class") * favour)
    ratio = F.when(size > 0, F.col("target") / size).otherwise(F.lit(0.0))
    found = join_on(by_class, targets, ["source"], "inner").withColumns({"f": f, "certain": F.floor(ratio + NONE)})
    found = found.withColumn("missing", F.greatest(F.col("target") - F.col("certain") * size, F.lit(0.0)))
    before = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("f")).over(down.rowsBetween(0, Window.unboundedFollowing))
    found = found.withColumn("level", F.when(rest > 0, (F.col("missing") - before) / rest).otherwise(F.lit(0.0)))
    fits = F.col("level") * F.col("f") <= 1 + NONE
    found = found.withColumn("level", F.min(F.when(fits, F.struct((-F.col("class")).alias("turn"), "level"))).over(of)["level"])
    found = found.withColumn("p", F.greatest(F.col("level") * F.col("f"), F.lit(0.0)))
    full = F.col("p") >= 1 - NONE
    missing = F.col("missing") - F.coalesce(F.sum(F.when(full, F.col("words"))).over(of), F.lit(0))
    return found.withColumns({"missing": missing, "certain": F.col("certain") + full.cast("long"), "p": F.when(full, F.lit(0.0)).otherwise(F.col("p"))}).select("source", "class", "source_size", "target", "certain", "p", "missing")


def drawn(*parts: Column) -> Column:
    """A random whole number of 52 bits from a hash of the parts."""
    told = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *told)), 1, 13), 16, 10).cast("long")


def own_draws(sizes: DataFrame) -> DataFrame:
    """sizes in which rows with the same draw, equal rows above all, have draws of their own: from the first one and their number.

    A row's number is its place among its equals in its partition and their count in the partitions before, so no window spans
    more than one partition's equal rows.
    """
    several = looked_up(sizes.groupBy("draw").agg(F.count("*").alias("rows")).filter("rows > 1").select("draw"), "several")
    if small_enough(several, 0):
        return sizes
    equal = sizes.join(several, "draw").select("draw", "row", F.shiftright("row", 33).alias("part"))
    counts = equal.groupBy("draw", "part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("draw").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("draw", "part", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("draw", "part").orderBy("row")) - 1
    numbered = equal.withColumn("place", place).join(counts, ["draw", "part"]).select("row", "draw", (F.col("place") + F.col("before")).alias("n")).filter("n > 0")
    anew = looked_up(numbered.select("row", drawn(F.col("draw"), F.col("n")).alias("own")), "draws")
    return sizes.join(anew, "row", "left").withColumn("draw", F.coalesce("own", "draw")).drop("own")


def rank_key(p):
    """The Pareto ranking variable as a number from 0 to 1 (q / (1+q), which keeps the order)."""
    u = (F.col("draw").cast("double") + 0.5) / F.lit(float(1 << 52))
    odds = (u / (1 - u)) / (p / (1 - p))
    return odds / (1 + odds)


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), total_ratio: float = 1.5, max_ratio: float = 2.0, seed: int = 7, favour: float = 0.25) -> DataFrame:
    """A row for each document: doc_id, text_key, source, size, source_size, target, copies, taken (copies times size)."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    narrow = narrow.withColumn("draw", drawn(F.lit(seed), F.col("doc_id"), F.col("source"), F.md5("text")))
    sizes = materialize(arrow_map(narrow, sized, "doc_id bigint, source string, text_key bigint, draw bigint, size bigint").withColumn("row", F.monotonically_increasing_id()), "sizes")
    sizes = own_draws(sizes).withColumn("class", size_class(F.col("size")))
    by_class = materialize(sizes.groupBy("source", "class").agg(F.sum("size").alias("words")), "classes")
    targets = source_targets(by_class.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total_ratio, max_ratio)
    odds = looked_up(inclusion(by_class, targets, favour), "odds")
    ranked = (
        join_on(sizes, odds, ["source", "class"], "inner")
        .withColumn("rank", F.when(F.col("p") > NONE, rank_key(F.col("p"))).otherwise(F.lit(1.0)))
        .withColumn("bucket", F.least(F.floor(F.col("rank") * BUCKETS), F.lit(BUCKETS - 1)))
    )
    ranked = materialize(ranked, "ranked")
    summed = ranked.filter(F.col("p") > NONE).groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
    to_here = Window.partitionBy("source").orderBy("bucket")
    reached = (F.col("before") <= F.col("missing")) & (F.col("before") + F.col("words") > F.col("missing"))
    cut = summed.withColumn("before", F.sum("words").over(to_here) - F.col("words")).filter(reached).select("source", F.col("bucket").alias("cut"), "before")
    placed = join_on(ranked, looked_up(cut, "cut"), ["source"], "left")
    key = F.struct("rank", "doc_id", "size", "row")
    in_order = Window.partitionBy("source", "bucket").orderBy("rank", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.filter((F.col("bucket") == F.col("cut")) & (F.col("p") > NONE)).withColumn("upto", F.col("before") + F.sum("size").over(in_order))
    fits = F.col("upto") <= F.col("missing")
    edge = edge.groupBy("source").agg(F.max(F.when(fits, key)).alias("last"), F.max(F.when(fits, F.col("upto"))).alias("reached"))
    at_edge = (F.col("bucket") == F.col("cut")) & (key <= F.col("last"))
    placed = join_on(placed, looked_up(edge, "edge"), ["source"], "left").withColumn("in_sample", (F.col("p") > NONE) & F.coalesce((F.col("bucket") < F.col("cut")) | at_edge, F.lit(False)))
    short = F.col("missing") - F.coalesce("reached", "before")
    off = F.abs(short - F.col("size"))
    pick = placed.filter(~F.col("in_sample") & (F.col("p") > NONE) & F.col("cut").isNotNull() & (off < short)).groupBy("source").agg(F.min(F.struct(off.alias("off"), "rank", "doc_id", "size", "row")).alias("pick"))
    return (
        join_on(placed, looked_up(pick.select("source", F.col("pick.row").alias("closing_row")), "pick"), ["source"], "left")
        .withColumn("copies", (F.col("certain") + (F.col("in_sample") | F.coalesce(F.col("row") == F.col("closing_row"), F.lit(False))).cast("long")).cast("long"))
        .select("doc_id", "text_key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )

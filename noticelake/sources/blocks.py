"""Large text files by block: lines with their numbers, CSV records that may hold line feeds, tails.

Spark's text reader cuts a file into blocks and deals its lines to tasks. What lies across blocks, a line's number or whether a
block begins inside a quoted cell, comes from one small row for each block, summed in the blocks' order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IN_FILE = ["file", "block"]


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, id, line): lines by line feed with the block they begin in; ids ascend within a block, without gaps."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.make_valid_utf8("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line), numbered from 1 in each file. Blocks are counted in one scan, lines numbered in another; both scans deal
    the blocks alike."""
    blocks = physical_lines(spark, path).groupBy(*IN_FILE).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    so_far = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(F.col("file").alias("__file"), F.col("block").alias("__block"), (F.coalesce(F.sum("n").over(so_far), F.lit(0)) - F.col("first") + 1).alias("__shift"))
    lines = physical_lines(spark, path)
    met = lines.join(starts, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")))
    return met.select("file", (F.col("id") + F.col("__shift")).alias("line_no"), "line")


def tail_lines(spark: SparkSession, file: str, most: int, wanted: Callable[[str], bool] | None = None, block: int = 1 << 16) -> list[tuple[int, str]]:
    """(place, line) of the last lines of one file, those that are wanted, by bytes from the file's start.

    Blocks are read from the end, each once, until there are enough lines, so little more is read than is shown; where hardly
    a line is wanted that may be the whole file.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    at, pieces, found = fs.getFileStatus(path).getLen(), [], []
    stream = fs.open(path)
    try:
        while at > 0 and len(found) < most:
            start = max(0, at - block)
            stream.seek(start)
            data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, at - start))
            if not pieces and not found:
                data = data.removesuffix(b"\n")
            at, first = start, data.find(b"\n")
            if first < 0 and at > 0:  # a line longer than a block
                pieces.append(data)
                continue
            whole = data + b"".join(reversed(pieces))
            pieces = []
            if at > 0:
                pieces, whole, place = [whole[: first + 1]], whole[first + 1 :], at + first + 1
                pieces[0] = pieces[0].removesuffix(b"\n")
            else:
                place = 0
            lines = []
            for line in whole.split(b"\n"):
                lines.append((place, line.decode("utf-8", "replace").removesuffix("\r")))
                place += len(line) + 1
            found = [x for x in lines if wanted is None or wanted(x[1])] + found
        return found[-most:] if most else []
    finally:
        stream.close()


# ---- CSV


def inside_after(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open after a line, if one was (or none was) before it. A quote opens a cell only at the cell's start."""
    at = 0
    if not inside:
        if line.startswith('"'):
            inside, at = True, 1
        elif '"' not in line:
            return False
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            inside, at = False, at + 1
        else:
            at = line.find(',"', at)
            if at < 0:
                return False
            inside, at = True, at + 2


def block_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, from_out, from_in): whether a cell is open at a block's end, for either state it may begin in."""
    at, states = None, (False, True)
    for batch in batches:
        for file, block, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "line"))):
            if (file, block) != at:
                if at is not None:
                    yield pa.RecordBatch.from_pydict({"file": [at[0]], "block": [at[1]], "from_out": [states[0]], "from_in": [states[1]]})
                at, states = (file, block), (False, True)
            if '"' in line:
                states = (inside_after(line, states[0]), inside_after(line, states[1]))
    if at is not None:
        yield pa.RecordBatch.from_pydict({"file": [at[0]], "block": [at[1]], "from_out": [states[0]], "from_in": [states[1]]})


PIECES = "file string, block bigint, no bigint, open_before boolean, open_after boolean, record string"


def block_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that begin in each block, by number from 1; number 0 is what a block's beginning adds to an earlier block's last
    one. open_before and open_after tell where a record goes on from the block before or into the next."""
    at, inside, no, held, out = None, False, 0, [], []

    def put(after: bool):
        nonlocal held, no
        if held:
            out.append((*at, no, no == 0, after, "\n".join(held)))
        held = []

    def sent():
        columns = list(zip(*out)) or [()] * 6
        out.clear()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in PIECES.split(", ")])

    for batch in batches:
        for file, block, line, begins in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "line", "open"))):
            if (file, block) != at:
                put(inside)
                at, inside, no = (file, block), begins, 0 if begins else 1
            held.append(line)
            inside = inside_after(line, inside) if inside or '"' in line else False
            if not inside:
                put(False)
                no += 1
        yield sent()
    put(inside)
    yield sent()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, no, record): the raw records of CSV files, of which a cell may hold line feeds and doubled quotes.

    Each block is read twice, by as many tasks as there are blocks: first for its two states, whose composition in the order of a
    file's blocks (one row each) tells which one it begins in, then to be cut. A record belongs to the block in which it begins.
    Records that cross blocks, at most one at each border, are put together by block.
    """
    lines = physical_lines(spark, path).select(*IN_FILE, "line")
    states = lines.mapInArrow(block_states, "file string, block bigint, from_out boolean, from_in boolean")
    listed = states.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "from_out", "from_in"))).alias("all"))
    zero = F.struct(F.lit(False).alias("open"), F.array().cast("array<struct<block:bigint,open:boolean>>").alias("seen"))
    step = lambda s, b: F.struct(F.when(s["open"], b["from_in"]).otherwise(b["from_out"]).alias("open"), F.concat(s["seen"], F.array(F.struct(b["block"].alias("block"), s["open"].alias("open")))).alias("seen"))
    begins = listed.select(F.col("file").alias("__file"), F.explode(F.aggregate("all", zero, step, lambda s: s["seen"])).alias("x")).select("__file", F.col("x.block").alias("__block"), F.col("x.open").alias("open"))
    told = lines.join(F.broadcast(begins), (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block"))).select(*IN_FILE, "line", "open")
    pieces = told.mapInArrow(block_records, PIECES)
    crossing = F.col("open_before") | F.col("open_after")
    by_file = Window.partitionBy("file").orderBy("block", "no")
    torn = pieces.filter(crossing).withColumn("owner", F.sum(F.when(~F.col("open_before"), 1).otherwise(0)).over(by_file))
    whole = torn.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "no", "record"))).alias("all"))
    mended = whole.select("file", F.get("all", F.lit(0))["block"].alias("block"), F.get("all", F.lit(0))["no"].alias("no"), F.array_join(F.transform("all", lambda x: x["record"]), "\n").alias("record"))
    return pieces.filter(~crossing).select("file", "block", "no", "record").unionByName(mended)


def cells(record: Column, names: list[str]) -> Column:
    """struct of a raw record's cells, all strings; missing ones are null."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return F.from_csv(record, F.lit(schema), {"quote": '"', "escape": '"', "multiLine": "true"})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All columns of CSV files as strings; the files have the same first line. Blank lines are no rows."""
    records = csv_records(spark, path).withColumn("record", F.regexp_replace("record", "\r$", ""))
    first = (F.col("block") == 0) & (F.col("no") == 1)
    heads = [r["record"].removeprefix("﻿") for r in records.filter(first).select("record").distinct().limit(2).collect()]
    if not heads:
        raise ValueError(f"no header in {path}")
    if len(set(heads)) > 1:
        raise ValueError(f"files of different columns: {heads}")
    numbered = [f"c{k}" for k in range(heads[0].count(",") + 1)]
    named = [n for n in spark.range(1).select(cells(F.lit(heads[0]), numbered).alias("x")).select("x.*").first() if n is not None]
    rows = records.filter(~first & (F.col("record") != "")).select(cells(F.col("record"), numbered[: len(named)]).alias("x"))
    return rows.select(*[F.col(f"x.c{k}").alias(n) for k, n in enumerate(named)])

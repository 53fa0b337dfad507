"""Best-fit packing of token sequences by sums of squares.

Texts become token ids (any `tokenizers` file) and one end id; only longer ones are cut, into full-length pieces. Pieces are
dealt at random, by a hash of what they are (equal rows of a slice by their number), into groups of a bounded number; a group is
packed from its longest piece down. A piece goes to the open bin
for which the squared counts of open bins per residual gap become smallest, to a new bin only if no open one has room.
The counts need a table of `capacity` numbers, however many pieces there are.

Tokens of a text are the tokens of its words where no token, normalisation or added token of the tokenizer reaches across ASCII
white space; a worker then keeps a bounded table of words it has seen. Whether that holds is tried on probes when the file is
read; with a tokenizer for which it does not, whole texts are encoded.

Nulls: a null text is empty and becomes the end id alone. Repeated rows are packed each. A null doc_id stays null. An empty
table gives an empty result; extra columns are ignored. Ties go to the smallest gap, in it to the bin opened last.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_batches, slices
from .tokens import word_tokenizer

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, grp bigint"
#: Bytes of text tokenised at a time.
SLICE = 2 << 20


def cutter(path: str, capacity: int, end_id: int, groups: int, keep_ids: bool):
    def run(batches):
        tokenizer = word_tokenizer(path)
        for batch in slices(batches, "text", SLICE):
            ids, offsets = tokenizer.batch_ids(pc.fill_null(batch.column("text"), ""), end_id)
            docs, out, alike = batch.column("doc_id").to_pylist(), [], Counter()
            for doc, low, high in zip(docs, offsets[:-1].tolist(), offsets[1:].tolist()):
                for piece, at in enumerate(range(low, high, capacity)):
                    raw = ids[at : min(at + capacity, high)].astype("<u4").tobytes()
                    crc = zlib.crc32(raw)
                    alike[doc, piece, crc] += 1
                    grp = xxhash.xxh3_64_intdigest(f"{doc} {piece} {crc} {alike[doc, piece, crc]}") % groups
                    out.append((doc, piece, at - low, len(raw) // 4, crc, grp, raw if keep_ids else None))
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "grp", "ids"]
            keep = len(names) if keep_ids else len(names) - 1
            yield batch_of(names[:keep], [pa.array(c, k) for c, k in zip(columns[:keep], kinds)])

    run.keeps_tables = True
    return run


class SumOfSquares:
    """Places pieces one at a time; counts[g] is the number of open bins with a gap of g."""

    def __init__(self, capacity: int):
        self.capacity, self.counts, self.bins, self.made = capacity, np.zeros(capacity + 1, np.int64), [[] for _ in range(capacity + 1)], 0

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset in it."""
        capacity, counts = self.capacity, self.counts
        open_ = counts[size:capacity]
        fits = np.flatnonzero(open_)
        if len(fits):
            grows = counts[fits] - open_[fits] + 1  # half the change of the sum of squares, but for a bin that becomes full
            if fits[0] == 0:
                grows = grows.astype(np.float64)
                grows[0] = 0.5 - open_[0]
            gap = int(fits[np.argmin(grows)]) + size
            bin_ = self.bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, bin_ = capacity, self.made
            self.made += 1
        if gap > size:
            counts[gap - size] += 1
            self.bins[gap - size].append(bin_)
        return bin_, capacity - gap


def packer(capacity: int, names: list[str]):
    def run(batches):
        group, bins = None, None
        for batch in batches:
            grp, lengths = batch.column("grp").to_pylist(), batch.column("length").to_pylist()
            sequence, offset = [], []
            for g, n in zip(grp, lengths):
                if g != group:
                    group, bins = g, SumOfSquares(capacity)
                b, o = bins.place(n)
                sequence.append((g << 40) + b)
                offset.append(o)
            kept = [batch.column(n) for n in names]
            yield batch_of([*names, "sequence_id", "offset"], [*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())])

    run.keeps_tables = True  # small beside the tokenizer, and the next cutter in this worker wants them
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, group_docs: int = 50_000, keep_ids: bool = False) -> DataFrame:
    """A row for each piece with its sequence and place; with keep_ids also the ids themselves (binary, 32-bit little-endian).

    A group holds about `group_docs` documents' pieces, so each task's memory and time are bounded at any input size.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    groups = max(1, math.ceil(docs.count() / group_docs))
    more = ", ids binary" if keep_ids else ""
    pieces = map_batches(narrow, cutter(tokenizer_path, capacity, end_id, groups, keep_ids), PIECES + more)
    order = [F.col("grp"), F.col("length").desc(), F.col("ids_crc32"), F.col("doc_id"), F.col("piece")]
    dealt = pieces.repartition(groups, "grp").sortWithinPartitions(*order)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    return map_batches(dealt, packer(capacity, names), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + more + ", sequence_id bigint, offset bigint")

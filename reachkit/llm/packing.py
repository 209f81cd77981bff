"""Packing by best-fit decreasing into windows of at most ``window`` tokens.

Every document is its token ids and an end id.  Overlong documents are first cut into full windows;
what remains of each document (at most one piece) is packed: pieces in falling size, each into the
tightest open window that takes it, found by a segment tree indexed by remaining capacity.

Scale: tokenizing is map-only and written once (only sizes and checksums, no ids).  The remainders are
dealt by a row number into groups of about ``group_pieces``; each group packs alone, so no task sees
more than a bounded number of pieces whatever the size or skew of the corpus.  Sequence numbers are
dense: per-task and per-group counts are summed in small tables.

Edge cases: a null or empty text is its end id alone; rows without a doc_id are left out; rows that
share a doc_id are packed apart; equal sizes are packed in the order of (doc_id, checksum); an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachkit.llm import common as c
from reachkit.llm.encoder import encoder

SEQUENCE = 1024
END_ID = 0
GROUP_PIECES = 8192


class CapacityTree:
    """Segment tree over remaining capacities 0..size: how many open windows have each, and the
    smallest capacity of at least some value that one has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = self.leaves + capacity
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, need: int) -> int | None:
        i = self.leaves + need
        if self.tree[i]:
            return need
        while i > 1 and (i & 1 or not self.tree[i + 1]):  # up until a right neighbour holds a window
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.leaves:  # its leftmost leaf
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(sizes: list[int], window: int) -> tuple[list[int], list[int]]:
    """(window number, offset) of every piece; sizes must fall and lie in 1..window."""
    tree, open_, used, out, offsets = CapacityTree(window), {}, [], [], []
    for size in sizes:
        room = tree.tightest(size)
        if room is None:
            number = len(used)
            used.append(0)
            room = window
        else:
            number = open_[room].pop()
            tree.add(room, -1)
        out.append(number)
        offsets.append(used[number])
        used[number] += size
        if room > size:
            open_.setdefault(room - size, []).append(number)
            tree.add(room - size, 1)
    return out, offsets


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, no long, full boolean"


def _pieces(docs: DataFrame, tokenizer_path: str, window: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part = encoder(tokenizer_path, "spaced"), TaskContext.get().partitionId()
        done = {True: 0, False: 0}
        for ids, buf, start, end in c.text_slices(batches, most=2 << 20):
            tokens, count = code(buf, start, end)
            total = count + 1
            stop = np.cumsum(total)
            out = np.full(int(stop[-1]) if len(stop) else 0, END_ID, "<u4")
            body = np.ones(len(out), bool)
            body[stop - 1] = False
            out[np.flatnonzero(body)] = tokens
            n = -(-total // window)
            row = np.repeat(np.arange(len(total)), n)
            first = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * window
            length = np.minimum(window, total[row] - first)
            at = (stop - total)[row] + first
            view = memoryview(out.tobytes())
            crcs = [c.crc(view[4 * a:4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            full = length == window
            no = np.where(full, done[True] + np.cumsum(full) - 1, done[False] + np.cumsum(~full) - 1)
            done = {True: done[True] + int(full.sum()), False: done[False] + int((~full).sum())}
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row)), pa.array(first), pa.array(length), pa.array(crcs, pa.int64()),
                 pa.array(total[row]), pa.array(np.full(len(row), part, np.int32)), pa.array(no), pa.array(full)],
                [x.split()[0] for x in PIECES.split(", ")])

    texts = c.documents(docs).where("doc_id is not null")
    return c.stored(c.mapped(texts, cut, PIECES), "packing-pieces")


def pack(docs: DataFrame, tokenizer_path: str, window: int = SEQUENCE,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    pieces = _pieces(docs, tokenizer_path, window)
    totals = c.stored(pieces.groupBy("part", "full").agg(F.count(F.lit(1)).alias("n")), "packing-totals")
    counted = totals.groupBy().agg(F.coalesce(F.sum(F.expr("if(full, n, 0)")), F.lit(0)).alias("whole"),
                                   F.coalesce(F.sum(F.expr("if(full, 0, n)")), F.lit(0)).alias("rest")).first()
    groups = c.group_count(docs.sparkSession, counted["rest"], group_pieces)

    # full windows: numbered by task, tasks one after the other
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.where("full").select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    whole = pieces.where("full").join(bases, "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("no")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))

    def pack_group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("ids_crc32", "ascending")])
        number, offset = best_fit_decreasing(table.column("length").to_pylist(), window)
        return (table.append_column("number", pa.array(number, pa.int64()))
                .append_column("offset", pa.array(offset, pa.int64())))

    rest = pieces.where("not full").withColumn("g", F.pmod(F.xxhash64("part", "no"), F.lit(groups)).cast("int"))
    rest = rest.select("g", "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    packed = rest.groupBy("g").applyInArrow(
        pack_group, "g int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, number long, offset long")
    packed = c.stored(packed, "packing-packed")
    sizes = packed.groupBy("g").agg((F.max("number") + 1).alias("n"))
    ahead = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    sizes = c.stored(sizes.select("g", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) + F.lit(counted["whole"])).alias("base")),
                     "packing-groups")
    rest = packed.join(F.broadcast(sizes) if groups <= 1 << 20 else sizes, "g").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("number")).alias("sequence_id"),
        "offset")
    return whole.unionByName(rest)

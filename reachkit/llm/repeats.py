"""Finding repeated fixed-length windows without moving every window through a shuffle.

A window of W units (words or bytes) is *owned* by the leftmost smallest of the hashes of its
k-unit grams.  Equal windows have equal owners at the same offset, so a window can only repeat if
its owner's hash (the *anchor*) occurs twice.  Consecutive windows with one owner form a *piece*;
every window lies in exactly one piece.  Stages:

1. anchors of every text, counted in Spark (partial aggregation combines hot anchors map-side);
2. pieces of the shared anchors only, keyed by (anchor, content hash);
3. equal pieces collapse to one row before anything looks inside them (hot copies pre-aggregate).

What happens inside the distinct pieces is up to the operator: ``substring`` counts Rabin-Karp
hashes of their windows, ``runindex`` streams them over a run-length BWT.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachkit.llm import common as c
from reachkit.llm.common import U64

ANCHORS = "doc_id long, tid long, anchors array<long>"


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost minimum (by the high 32 bits) of x[i:i+w] for every i: the minimum of
    hash and position in one value."""
    tagged = x & U64(0xFFFFFFFF00000000)
    tagged |= np.arange(len(x), dtype=U64)
    return (c.sliding(tagged, w) & U64(0xFFFFFFFF)).astype(np.int64)


def owned_runs(unit: np.ndarray, row: np.ndarray, n_rows: int, k: int, window: int):
    """Runs of windows with one owner: (first window, number of windows, anchor, row)."""
    n = len(unit)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none.astype(U64), none
    grams = c.rolling(unit, k)
    owner = sliding_argmin(grams, window - k + 1)
    j = np.flatnonzero(row[:n - window + 1] == row[window - 1:])  # windows inside one row
    if len(j) == 0:
        return none, none, none.astype(U64), none
    o = owner[j]
    new = np.ones(len(j), bool)
    new[1:] = (o[1:] != o[:-1]) | (row[j[1:]] != row[j[:-1]])
    first = np.flatnonzero(new)
    run = np.diff(np.concatenate([first, [len(j)]]))
    begin = j[first]
    return begin, run, grams[o[first]], row[begin]


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, tid, text``: rows are told apart by id and a hash of their text, so rows that share
    an id stay apart and repeated rows get the same result; rows without an id take no part."""
    return (c.documents(docs).where("doc_id is not null")
            .withColumn("tid", F.xxhash64("text")))


def shared_anchors(texts: DataFrame, units: Callable, k: int, window: int, twice: bool, name: str) -> DataFrame:
    """Per text the anchors that another place has too: ``doc_id, tid, anchors``.

    ``twice``: two places in one document count (else the anchor must lie in two documents)."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid = c.column(batch, "tid")
            done = 0
            for ids, buf, start, end in c.text_slices(iter([batch])):
                unit, row, _ = units(buf, start, end)
                _, _, anchor, at = owned_runs(unit, row, len(ids), k, window)
                order = np.lexsort((anchor, at))
                anchor, at = anchor[order], at[order]
                if not twice:  # one entry per document and anchor
                    keep = np.ones(len(at), bool)
                    keep[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1])
                    anchor, at = anchor[keep], at[keep]
                count = np.bincount(at, minlength=len(ids))
                some = count > 0
                yield pa.RecordBatch.from_arrays(
                    [ids.filter(pa.array(some)), tid.slice(done, len(ids)).filter(pa.array(some)),
                     c.lists(pa.array(anchor.view(np.int64)), count[some])], ["doc_id", "tid", "anchors"])
                done += len(ids)

    found = c.stored(c.mapped(texts, anchors, ANCHORS), f"{name}-anchors")
    each = found.select("doc_id", "tid", F.explode("anchors").alias("anchor"))
    per = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"),
                                     F.max("doc_id").alias("hi"))
    shared = c.stored(per.where("n > 1" if twice else "lo < hi").select("anchor"), f"{name}-shared")
    # both sides come from written tables, so a hot anchor's rows can be split by the skew join
    mine = each.join(shared.hint("merge"), "anchor")
    return mine.groupBy("doc_id", "tid").agg(F.collect_set("anchor").alias("anchors"))


def pieces(texts: DataFrame, shared: DataFrame, units: Callable, k: int, window: int,
           payload: Callable, name: str) -> DataFrame:
    """Pieces of the shared anchors: ``anchor, content, doc_id, tid, pos, run, payload``.

    ``payload(buf, unit_begin, unit, begin, run)`` returns the values of every piece (flat, counts);
    ``content`` is their 64-bit hash.  ``pos`` counts units from the start of the text."""
    schema = "anchor long, content long, doc_id long, tid long, pos int, run int, payload binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid, lists, done = c.column(batch, "tid"), c.column(batch, "anchors"), 0
            for ids, buf, start, end in c.text_slices(iter([batch])):
                unit, row, where = units(buf, start, end)
                begin, run, anchor, at = owned_runs(unit, row, len(ids), k, window)
                some = np.unique(lists.slice(done, len(ids)).flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
                keep = np.isin(anchor.view(np.int64), some)
                begin, run, anchor, at = begin[keep], run[keep], anchor[keep], at[keep]
                first = np.searchsorted(row, np.arange(len(ids)))
                for i in range(0, len(begin), 20_000):  # bounded output batches
                    b, r, t = begin[i:i + 20_000], run[i:i + 20_000], at[i:i + 20_000]
                    values, counts, content = payload(buf, where, unit, b, r)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[i:i + 20_000].view(np.int64)), pa.array(content.view(np.int64)),
                         ids.take(pa.array(t)), tid.slice(done, len(ids)).take(pa.array(t)),
                         pa.array((b - first[t]).astype(np.int32)), pa.array(r.astype(np.int32)),
                         c.packed(values, counts)], names)
                done += len(ids)

    names = [x.split()[0] for x in schema.split(", ")]
    return c.stored(c.mapped(texts.join(shared, ["doc_id", "tid"]), cut, schema), f"{name}-pieces")


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated index ranges begin[i] .. begin[i] + size[i]."""
    off = np.cumsum(size) - size
    return np.arange(int(size.sum()), dtype=np.int64) - np.repeat(off - begin, size)

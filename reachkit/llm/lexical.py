"""Ranked lexical search: exact inner products over sparse ball trees.

Terms are the lower-cased (A-Z) maximal runs of ASCII digits, ASCII letters and all other characters above
U+007F.  With N documents that hold a term, L terms in all of them, df documents that hold a term, tf
occurrences in a document of n terms, a term weighs w = floor(1000 * ln((2N + 2) / (2 df + 1))) and a
document's score is the sum over the item's terms, repeats included, of w * (10**9 tf div (1000 tf + 8 m))
with m = 100 - 75 + (75 n N div L): an inner product of integers.

1. one pass over the texts keeps, per document, n and the occurrences of the items' terms; N, L and df are
   summed in Spark;
2. every task reads its documents in chunks of bounded size and builds, for groups of ``GROUP_ITEMS`` items,
   a ball tree over the documents' vectors w * v on the group's terms: a node holds the centroid and the
   radius of its documents, split by their distance to two far points;
3. an item goes down best first: a node's score is at most q.centroid + |q| * radius, rounded up by more
   than the doubles can err, so a node is skipped only if no document in it can reach the ``top`` best so
   far; leaves are scored in 64-bit integers;
4. the scores to beat come from a bounded sample of documents that is searched first; a task returns its
   ``top`` best of every item, Spark keeps the best of all.

The items are the queries: they are taken in blocks of at most ``BLOCK_TERMS`` terms (a longer item is a
block of its own), so what travels with a task is bounded.  The texts are read once per block.

Edge cases: null, empty or termless texts of documents count nowhere and are never returned, nor is a
score of 0; an item without terms gives no row; rows without a doc_id or item_id are left out; rows that
share a doc_id are documents of their own; repeated rows of an item count once, different texts under one
item_id are searched one by one; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachkit.llm import common as c
from reachkit.llm.common import U64
from reachkit.llm.repeats import ranges

TOP = 10
GROUP_ITEMS = 16  # items that share a tree
LEAF = 64  # documents of a leaf, at most
CHUNK_ROWS = 8192  # documents of a tree, at most
CHUNK_BYTES = 8 << 20  # of their vectors (one document more at most)
BLOCK_TERMS = 1 << 18  # terms of a block of items
SEED_DOCS = 8192  # documents whose scores are to be beaten, about
_SLACK = 1e-9  # relative; doubles err by less than 1e-11 in these sums


# ---------------------------------------------------------------- items and vectors

@dataclass
class Items:
    """A block of items: one row per (item, different term)."""

    ids: list[int]  # item_id of every item
    tids: list[int]  # text hash of every item
    vocab: np.ndarray  # sorted hashes of the block's terms
    ptr: np.ndarray  # terms of item i: ptr[i] .. ptr[i + 1]
    term: np.ndarray  # numbers in vocab
    times: np.ndarray  # occurrences in the item


def _terms(buf, start, end):
    """(hash, row) of every term."""
    low = c.LOWER[buf]
    ws, we, row = c.words(low, start, end, c.NOT_ALNUM)
    return c.word_hashes(low, ws, we), row


def _per_row(value: np.ndarray, row: np.ndarray):
    """(row, value, occurrences) of the different values of every row, in order."""
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    first = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (row[1:] != row[:-1]))) if len(value) else np.zeros(0, np.int64)
    return row[first], value[first], np.diff(np.append(first, len(value))).astype(np.int64)


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, tid, n, hashes, times`` of every different item with terms."""
    schema = "item_id long, tid long, n long, hashes binary, times binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid, done = c.column(batch, "tid"), 0
            for ids, buf, start, end in c.text_slices(iter([batch]), "item_id"):
                row, value, times = _per_row(*_terms(buf, start, end))
                n = np.bincount(row, minlength=len(ids)).astype(np.int64)
                some = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays(
                    [ids.filter(some), tid.slice(done, len(ids)).filter(some), pa.array(n).filter(some),
                     c.packed(value, n).filter(some), c.packed(times, n).filter(some)], [x.split()[0] for x in schema.split(", ")])
                done += len(ids)

    c.ship(items.sparkSession)
    texts = (items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
             .where("item_id is not null and text is not null").withColumn("tid", F.xxhash64("text")).dropDuplicates(["item_id", "tid"]))
    return c.stored(c.mapped(texts, run, schema), "lexical-items")


def blocks(terms: DataFrame, block_terms: int = BLOCK_TERMS) -> Iterator[Items]:
    """The items in blocks of bounded size, collected one after the other."""
    held = terms.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if held == 0:
        return
    n_blocks = c.group_count(terms.sparkSession, 2 * held, block_terms)
    for k in range(n_blocks):
        mine = terms.where(F.pmod(F.xxhash64("item_id", "tid"), F.lit(n_blocks)) == k).orderBy("item_id", "tid")
        part: list = []
        size = 0
        for r in mine.toLocalIterator():
            if part and size + r["n"] > block_terms:
                yield _block(part)
                part, size = [], 0
            part.append(r)
            size += r["n"]
        if part:
            yield _block(part)


def _block(rows: list) -> Items:
    hashes = np.concatenate([np.frombuffer(r["hashes"], U64) for r in rows])
    times = np.concatenate([np.frombuffer(r["times"], np.int64) for r in rows])
    vocab, term = np.unique(hashes, return_inverse=True)
    ptr = np.concatenate([[0], np.cumsum([r["n"] for r in rows])]).astype(np.int64)
    return Items([r["item_id"] for r in rows], [r["tid"] for r in rows], vocab, ptr, term.astype(np.int64), times)


VECTORS = "doc_id long, tid long, n long, terms binary, tfs binary"


def document_vectors(docs: DataFrame, vocab: np.ndarray) -> DataFrame:
    """``doc_id, tid, n, terms, tfs`` of every document with a term: its number of terms, and which of
    ``vocab`` it holds how often."""
    maybe = np.zeros(1 << 16, bool)
    maybe[(vocab & U64(0xFFFF)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid, done = c.column(batch, "tid"), 0
            for ids, buf, start, end in c.text_slices(iter([batch])):
                value, row = _terms(buf, start, end)
                n = np.bincount(row, minlength=len(ids)).astype(np.int64)
                at = np.flatnonzero(maybe[(value & U64(0xFFFF)).astype(np.int64)])
                place = np.minimum(np.searchsorted(vocab, value[at]), len(vocab) - 1)
                same = vocab[place] == value[at]
                held, term, tf = _per_row(place[same], row[at[same]])
                per = np.bincount(held, minlength=len(ids)).astype(np.int64)
                some = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays(
                    [ids.filter(some), tid.slice(done, len(ids)).filter(some), pa.array(n).filter(some),
                     c.packed(term.astype("<i4"), per).filter(some), c.packed(tf.astype("<i4"), per).filter(some)],
                    [x.split()[0] for x in VECTORS.split(", ")])
                done += len(ids)

    texts = c.documents(docs).where("doc_id is not null and text is not null").withColumn("tid", F.xxhash64("text"))
    return c.stored(c.mapped(texts, run, VECTORS), "lexical-vectors")


def _statistics(vectors: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(N, L, df of every term): sums over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            buf, start, end = c.flat(c.column(batch, "terms"))
            if len(start):
                df += np.bincount(buf[int(start[0]):int(end[-1])].view("<i4"), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    whole = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = np.zeros(n_terms, np.int64)
    # one row per term of the block
    for r in c.mapped(vectors.select("terms"), run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    return whole["n"], whole["l"], df


def term_weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(tf: np.ndarray, n_terms: np.ndarray, n: int, held: int) -> np.ndarray:
    """10**9 tf div (1000 tf + 8 m)."""
    m = 100 - 75 + (75 * n_terms * n) // held
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


# ---------------------------------------------------------------- the tree

class BallTree:
    """Sparse non-negative vectors (rows of a CSR matrix) in balls of a centroid and a radius."""

    def __init__(self, ptr: np.ndarray, col: np.ndarray, value: np.ndarray, width: int, leaf: int = LEAF):
        """``value``: int64 entries; every row holds one at least."""
        self.ptr, self.col, self.value, self.width = ptr, col, value, width
        self.real = value.astype(np.float64)
        size = np.diff(ptr)
        row = np.repeat(np.arange(len(size)), size)
        self.square = np.bincount(row, weights=self.real * self.real, minlength=len(size))
        self.rows: list[np.ndarray] = []  # of every node
        self.children: list[tuple[int, int] | None] = []
        centres, radii = [], []
        stack = [np.arange(len(size))]
        parents = [(-1, 0)]
        while stack:
            mine, (parent, side) = stack.pop(), parents.pop()
            number = len(self.rows)
            if parent >= 0:
                pair = self.children[parent] or (-1, -1)
                self.children[parent] = (number, pair[1]) if side == 0 else (pair[0], number)
            entry = ranges(ptr[mine], size[mine])
            at = np.repeat(np.arange(len(mine)), size[mine])
            cols, real = col[entry], self.real[entry]
            centre = np.bincount(cols, weights=real, minlength=width) / max(len(mine), 1)
            away = self._squares(centre, mine, at, cols, real)
            # the squares cancel: their error is relative to the vectors, not to the distance
            most = float(self.square[mine].max()) + float(centre @ centre) if len(mine) else 0.0
            radii.append(math.sqrt(max(float(away.max()) if len(mine) else 0.0, 0.0) + _SLACK * most) * (1 + _SLACK))
            centres.append(centre)
            self.rows.append(mine)
            self.children.append(None)
            if len(mine) <= leaf or float(away.max()) <= _SLACK * most:
                continue  # a ball of equal vectors is one leaf, however many they are
            one = int(away.argmax())
            far = self._squares(self._dense(mine[one]), mine, at, cols, real)
            two = int(far.argmax())
            other = self._squares(self._dense(mine[two]), mine, at, cols, real)
            left = far < other
            if left.all() or not left.any():
                continue
            stack += [mine[~left], mine[left]]
            parents += [(number, 1), (number, 0)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.width)
        out[self.col[self.ptr[row]:self.ptr[row + 1]]] = self.real[self.ptr[row]:self.ptr[row + 1]]
        return out

    def _squares(self, point, mine, at, cols, real) -> np.ndarray:
        """Squared distances of the rows to a point."""
        return self.square[mine] - 2 * np.bincount(at, weights=real * point[cols], minlength=len(mine)) + float(point @ point)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What no vector of a node exceeds, [node, query]."""
        norm = np.sqrt((queries * queries).sum(0))
        return (self.centres @ queries + np.outer(self.radii, norm)) * (1 + _SLACK) + 1

    def search(self, bound: np.ndarray, query: np.ndarray, ids: np.ndarray, top: int, least: int) -> tuple[list[tuple[int, int, int]], int]:
        """(best (-score, id, row) with a score of at least ``least``, leaves scored) for one integer query:
        nodes by falling bound."""
        best: list[tuple[int, int, int]] = []
        heap, scored = [(-bound[0], 0)], 0
        while heap:
            high, node = heapq.heappop(heap)
            if -high < least:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    if bound[child] >= least:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            scored += 1
            mine = self.rows[node]
            size = self.ptr[mine + 1] - self.ptr[mine]
            entry = ranges(self.ptr[mine], size)
            score = np.add.reduceat(query[self.col[entry]] * self.value[entry], np.cumsum(size) - size)
            good = np.flatnonzero(score >= least)
            if len(good) > top:
                good = good[np.lexsort((ids[mine[good]], -score[good]))[:top]]
            best = heapq.nsmallest(top, best + [(-int(score[i]), int(ids[mine[i]]), int(mine[i])) for i in good])
            if len(best) == top:
                least = max(least, -best[-1][0])
        return best, scored


# ---------------------------------------------------------------- search

FOUND = "item long, doc_id long, score long"


def _search(vectors: DataFrame, items: Items, weight: np.ndarray, n: int, held: int, least: np.ndarray, top: int,
            group_items: int, chunk_rows: int) -> DataFrame:
    """``item (number), doc_id, score``: every task's best."""
    groups = [range(i, min(i + group_items, len(items.ids))) for i in range(0, len(items.ids), group_items)]

    def chunk(parts: list) -> Iterator[pa.RecordBatch]:
        ids, n_terms, size, term, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
        row = np.repeat(np.arange(len(ids)), size)
        value = impacts(tf.astype(np.int64), n_terms[row], n, held) * weight[term]
        out: list[tuple[int, int, int]] = []
        local = np.full(len(items.vocab), -1, np.int64)
        for group in groups:
            mine = np.unique(items.term[items.ptr[group[0]]:items.ptr[group[-1] + 1]])
            local[mine] = np.arange(len(mine))
            keep = np.flatnonzero((local[term] >= 0) & (value > 0))
            docs, count = np.unique(row[keep], return_counts=True)
            if len(docs):
                tree = BallTree(np.concatenate([[0], np.cumsum(count)]), local[term[keep]], value[keep], len(mine))
                queries = np.zeros((len(mine), len(group)), np.int64)
                for k, item in enumerate(group):
                    at = slice(items.ptr[item], items.ptr[item + 1])
                    queries[local[items.term[at]], k] = items.times[at]
                bound = tree.bounds(queries.astype(np.float64))
                for k, item in enumerate(group):
                    found, _ = tree.search(bound[:, k], queries[:, k], ids[docs], top, max(int(least[item]), 1))
                    out += [(item, doc, -score) for score, doc, _ in found]
            local[mine] = -1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["item", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        rows = size = 0
        for batch in batches:
            buf, start, end = c.flat(c.column(batch, "terms"))
            tfs, ts, te = c.flat(c.column(batch, "tfs"))
            ids, n_terms = c.column(batch, "doc_id").to_numpy(), c.column(batch, "n").to_numpy()
            for i, j in c.row_slices(start, end, CHUNK_BYTES):
                j_ = i
                while j_ < j:  # chunks of bounded rows
                    k = min(j, j_ + chunk_rows - rows)
                    parts.append((ids[j_:k], n_terms[j_:k], (end - start)[j_:k] // 4,
                                  buf[int(start[j_]):int(end[k - 1])].view("<i4"), tfs[int(ts[j_]):int(te[k - 1])].view("<i4")))
                    rows, size, j_ = rows + k - j_, size + int(end[k - 1] - start[j_]), k
                    if rows >= chunk_rows or size >= CHUNK_BYTES:
                        yield from chunk(parts)
                        parts, rows, size = [], 0, 0
        if parts:
            yield from chunk(parts)

    return c.mapped(vectors.select("doc_id", "n", "terms", "tfs"), run, FOUND)


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, group_items: int = GROUP_ITEMS, chunk_rows: int = CHUNK_ROWS,
           seed_docs: int = SEED_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of every item with a score above 0."""
    spark = docs.sparkSession
    out = None
    for block in blocks(item_terms(items), block_terms):
        vectors = document_vectors(docs, block.vocab)
        n, held, df = _statistics(vectors, len(block.vocab))
        if n == 0:
            break
        weight = term_weights(n, df)
        least = np.zeros(len(block.ids), np.int64)
        every = n // seed_docs
        if every > 1:  # the last of the best in a part of the documents is no more than the last of all
            part = vectors.where(F.pmod(F.xxhash64("doc_id", "tid"), F.lit(every)) == 0)
            first = c.stored(_search(part, block, weight, n, held, least, top, group_items, chunk_rows), "lexical-seed")
            for r in _best(first, top).where(F.col("rank") == top).select("item", "score").collect():
                least[r["item"]] = r["score"]
        found = c.stored(_search(vectors, block, weight, n, held, least, top, group_items, chunk_rows), "lexical-found")
        names = spark.createDataFrame(pa.table({"item": np.arange(len(block.ids)), "item_id": pa.array(block.ids, pa.int64())}))
        best = (_best(found, top).join(F.broadcast(names), "item")  # one row per item of the block
                .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
        best = c.stored(best, "lexical-best")
        out = best if out is None else out.unionByName(best)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)

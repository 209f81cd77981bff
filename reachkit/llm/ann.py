"""Approximate nearest neighbours by an inverted multi-index.

A vector is cut into two halves; each half is quantised by its own codebook (k-means, trained on a
bounded sample).  A vector's cell is its pair of centroids.  A query ranks both codebooks' centroids
by their distance to its halves (for inner products: the negated product) and walks the pairs in the
order of summed distance with a heap, until the cells walked hold enough distinct vectors; those are
reranked by the exact inner product in double precision.

Spark jobs: every row is indexed.  Rows of one vector become one entry with its smallest ids (no query
can need more), so copies neither use up the walk nor fill a task.  Entries are dealt to blocks:
neighbouring first-half centroids share a slab of up to ``BLOCK_ROWS`` entries; a fuller one is spread
over blocks.  Queries are dealt to parts of about ``BLOCK_ROWS`` as well; a part and a block meet in a
group of their own, so both sides of every group are bounded (each entry travels to the
parts that ask for its block, each query to the blocks that it meets: where queries walk a share of all
vectors, the work grows with rows x queries).  The cells' counts (centroids squared: bounded) steer the walk; a query goes to the blocks
of the cells it walked, each block returns its ``top`` best rows, and the best of those win.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
vectors of another length than the most common one; rows without an id are left out; repeated rows are
rows of their own; a query with fewer candidates than ``top`` gets all; an empty table gives no row;
extra columns are ignored; ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachkit.llm import common as c
from reachkit.llm.repeats import ranges

SAMPLE = 16_384  # vectors used to fit the codebooks, at most
CENTROIDS = 96  # per half
ROUNDS = 12  # of k-means
VISIT = 6_000  # distinct vectors in the walked cells at least (all, if there are fewer), and
SHARE = 0.45  # of all distinct vectors: vectors without structure need a share for a recall of 0.9
BLOCK_ROWS = 4_096  # entries of a block, and queries of a part
ROUTE_ROWS = 512  # queries of a routing task
TOP = 20
SEED = 7


@dataclass
class Codebooks:
    first: np.ndarray  # centroids of the first half
    second: np.ndarray

    @property
    def cut(self) -> int:
        return self.first.shape[1]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(x[:, :self.cut], self.first), _nearest(x[:, self.cut:], self.second)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids ** 2).sum(1)[None, :] - 2 * x @ centroids.T, axis=1)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's iterations from a spread-out start; empty clusters restart at the farthest points."""
    rng = np.random.default_rng(seed)
    x = np.asarray(x, np.float64)
    centroids = np.unique(x, axis=0)
    if len(centroids) <= k:
        return centroids
    centroids = [x[rng.integers(len(x))]]
    far = ((x - centroids[0]) ** 2).sum(1)
    while len(centroids) < k:  # k-means++ start
        centroids.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[rng.integers(len(x))])
        far = np.minimum(far, ((x - centroids[-1]) ** 2).sum(1))
    centroids = np.array(centroids)
    for _ in range(rounds):
        near = _nearest(x, centroids)
        count = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, weights=x[:, j], minlength=k) for j in range(x.shape[1])], 1)
        empty = count == 0
        centroids = np.where(empty[:, None], centroids, total / np.maximum(count, 1)[:, None])
        if empty.any():
            away = ((x - centroids[near]) ** 2).sum(1)
            centroids[empty] = x[np.argsort(-away)[:int(empty.sum())]]
    return centroids


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Centroid pairs in the order of summed distance (a heap holds the frontier) until the walked
    cells hold ``enough`` vectors.  ``first``/``second``: distances of the query's halves."""
    by1, by2 = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    out, have = [], 0
    heap = [(float(first[by1[0]] + second[by2[0]]), 0, 0)]
    while heap and have < enough:
        _, i, j = heapq.heappop(heap)
        a, b = int(by1[i]), int(by2[j])
        if counts[a, b]:
            out.append((a, b))
            have += int(counts[a, b])
        # every pair has one parent: (i, j - 1), or (i - 1, 0) for j = 0
        if j + 1 < len(by2):
            heapq.heappush(heap, (float(first[a] + second[by2[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(by1):
            heapq.heappush(heap, (float(first[by1[i + 1]] + second[by2[0]]), i + 1, 0))
    return out


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` (array of double) of the vectors that take part."""
    v = vectors.where(f"{id_col} is not null and {vec_col} is not null").select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return v.where("""size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))
                      and exists(v, x -> x != 0)""")


def fit(v: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE) -> tuple[int, Codebooks | None]:
    """(common vector length, codebooks), trained on the driver on at most ``sample`` distinct vectors
    with the smallest hashes."""
    dims = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return 0, None
    rows = v.where(F.size("v") == dims["d"]).select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    x = np.array([r["v"] for r in rows], np.float64)
    cut = (dims["d"] + 1) // 2
    return dims["d"], Codebooks(k_means(x[:, :cut], centroids, ROUNDS, SEED),
                                k_means(x[:, cut:], centroids, ROUNDS, SEED + 1) if dims["d"] > cut else np.zeros((1, 0)))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), dim)


def index(v: DataFrame, dim: int, books: Codebooks) -> DataFrame:
    """Every vector with its cell: ``vec_id, c1, c2, v``, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = books.cells(_matrix(c.column(batch, "v"), dim))
            yield pa.RecordBatch.from_arrays(
                [c.column(batch, "vec_id"), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), c.column(batch, "v")],
                ["vec_id", "c1", "c2", "v"])

    return c.stored(v.where(F.size("v") == dim).mapInArrow(run, "vec_id long, c1 int, c2 int, v array<double>"), "ann-index")


def distinct(entries: DataFrame, top: int) -> DataFrame:
    """One entry per vector: ``c1, c2, v, ids, times``, written.  ``ids`` holds the vector's ``top`` + 1
    smallest ids (a query leaves out its own), ``times`` how many rows each has (``top`` at most)."""
    rows = entries.groupBy("v", "vec_id").agg(F.first("c1").alias("c1"), F.first("c2").alias("c2"),
                                              F.least(F.count("*"), F.lit(top)).alias("n"))
    # the limit of the window is applied before the shuffle too: a hot vector sends few rows
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= top + 1)
    held = F.sort_array(F.collect_list(F.struct("vec_id", "n")))
    one = few.groupBy("v").agg(F.first("c1").alias("c1"), F.first("c2").alias("c2"), held.alias("held"))
    return c.stored(one.select("c1", "c2", "v", F.col("held.vec_id").alias("ids"), F.col("held.n").alias("times")), "ann-distinct")


def slabs(per_first: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(slab of every first centroid, blocks of every slab): neighbouring first centroids share a slab
    while it holds at most ``block_rows`` rows; a fuller slab is dealt over several blocks."""
    slab, sizes = np.zeros(len(per_first), np.int64), [0]
    for i, n in enumerate(per_first.tolist()):
        if sizes[-1] and sizes[-1] + n > block_rows:
            sizes.append(0)
        slab[i] = len(sizes) - 1
        sizes[-1] += n
    return slab, np.maximum(1, -(-np.array(sizes) // block_rows))


def parted(queries: DataFrame, block_rows: int) -> tuple[DataFrame, int, int]:
    """(``vec_id, v, part`` of the different queries, rows, parts): parts of about ``block_rows``."""
    rows = queries.count()  # repeated rows ask once, so this is at least their number
    parts = c.group_count(queries.sparkSession, rows, block_rows)
    return (queries.select("vec_id", "v").distinct()
            .withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int")), rows, parts)


def search(entries: DataFrame, queries: DataFrame, dim: int, books: Codebooks, top: int = TOP, visit: int = VISIT,
           share: float = SHARE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` best rows found for every query but itself."""
    entries = distinct(entries, top)
    held = entries.groupBy("c1", "c2").count().collect()  # centroids squared: bounded
    counts = np.zeros((len(books.first), len(books.second)), np.int64)
    for r in held:
        counts[r["c1"], r["c2"]] = r["count"]
    enough = max(visit, int(share * counts.sum())) + 1  # the query's vector is an entry too
    slab, blocks = slabs(counts.sum(1), block_rows)
    width = counts.shape[1]

    def by_first(values) -> F.Column:
        return F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("c1") + 1)

    dealt = entries.select("ids", "times", "v", (F.col("c1") * width + F.col("c2")).alias("cell"), by_first(slab).alias("slab"),
                           F.pmod(F.xxhash64("v"), by_first(blocks[slab])).cast("int").alias("block"))
    questions, rows, parts = parted(queries, block_rows)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                x = _matrix(c.column(part, "v"), dim)
                d1, d2 = -x[:, :books.cut] @ books.first.T, -x[:, books.cut:] @ books.second.T
                at, slabs_, block, cells = [], [], [], []
                for q in range(len(x)):
                    pairs = np.array(walk(d1[q], d2[q], counts, enough), np.int64).reshape(-1, 2)
                    code, of = pairs[:, 0] * width + pairs[:, 1], slab[pairs[:, 0]]
                    for s in np.unique(of).tolist():
                        mine = np.sort(code[of == s]).astype(np.int32)
                        for k in range(int(blocks[s])):
                            at.append(q)
                            slabs_.append(s)
                            block.append(k)
                            cells.append(mine)
                take = pa.array(at, pa.int64())
                sizes = np.array([len(m) for m in cells], np.int64)
                flat = np.concatenate(cells) if cells else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [c.column(part, "vec_id").take(take), c.column(part, "part").take(take), pa.array(slabs_, pa.int32()), pa.array(block, pa.int32()),
                     c.packed(flat, sizes), c.column(part, "v").take(take)],
                    ["query_id", "part", "slab", "block", "cells", "v"])

    asked = c.stored(questions.repartition(c.group_count(entries.sparkSession, rows, ROUTE_ROWS), "vec_id", "v").mapInArrow(
        route, "query_id long, part int, slab int, block int, cells binary, v array<double>"), "ann-asked")
    # an entry travels to the parts that ask for its block
    wanted = c.stored(asked.select("part", "slab", "block").distinct(), "ann-wanted")
    dealt = dealt.join(wanted.hint("merge"), ["slab", "block"])

    def scan(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        """A part of the queries against one block: each query's best among the cells it walked."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            held, many = right.column("ids").combine_chunks(), right.column("times").combine_chunks()
            size = held.value_lengths().to_numpy().astype(np.int64)
            begin_ids = np.cumsum(size) - size
            ids, times = held.flatten().to_numpy(), many.flatten().to_numpy()
            cell, of = np.unique(right.column("cell").to_numpy(), return_inverse=True)
            x = _matrix(right.column("v").combine_chunks(), dim)
            for begin in range(0, left.num_rows, 256):
                part = left.slice(begin, 256)
                q, mine = _matrix(part.column("v").combine_chunks(), dim), part.column("query_id").to_numpy()
                near = q @ x.T
                for i, walked in enumerate(part.column("cells").to_pylist()):
                    at = np.flatnonzero(np.isin(cell, np.frombuffer(walked, np.int32), assume_unique=True)[of])
                    score, more = near[i, at], top + 1  # one vector may be the query's alone
                    if len(at) > more:  # the matrix product may round otherwise: keep what may tie
                        at = at[score >= np.partition(score, len(at) - more)[len(at) - more] - 1e-9 * (1 + abs(score).max())]
                    score = np.einsum("ij,j->i", x[at], q[i])  # rerank in double, in one order of summing
                    row = ranges(begin_ids[at], size[at])  # the rows of the vectors
                    score, other = np.repeat(score, size[at]), ids[row] != mine[i]
                    row, score = np.repeat(row[other], times[row[other]]), np.repeat(score[other], times[row[other]])
                    best = np.lexsort((ids[row], -score))[:top]
                    found.append((np.full(len(best), mine[i], np.int64), ids[row][best], score[best]))
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table({"query_id": pa.array(parts[0]), "vec_id": pa.array(parts[1]), "score": pa.array(parts[2])})

    found = asked.groupBy("slab", "block", "part").cogroup(dealt.groupBy("slab", "block", "part")).applyInArrow(
        scan, "query_id long, vec_id long, score double")
    # at most ``top`` rows per query and block
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            .select("query_id", "rank", "vec_id", "score"))


def digest(vectors: DataFrame, every: int = 20, top: int = TOP, visit: int = VISIT, share: float = SHARE) -> DataFrame:
    """The ``top`` nearest of every row whose id is divisible by ``every``, against all rows."""
    c.ship(vectors.sparkSession)
    v = usable(vectors)
    dim, books = fit(v)
    if books is None:
        return v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    entries = index(v, dim, books)
    return search(entries, entries.where(F.col("vec_id") % every == 0), dim, books, top, visit, share)

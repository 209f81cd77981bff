"""SimHash near-dedup by the generalised pigeonhole principle.

A document's fingerprint has 64 bits: bit i is 1 if it is set in over half of the XXH64 hashes (seed 42)
of the document's shingles, repeats included.  Documents whose fingerprints differ in at most ``radius``
bits are linked; a component is what links reach.

1. one pass over the texts gives the fingerprints; equal ones collapse to one row (combined map-side)
   with their smallest doc_id;
2. the 64 bits are cut into ``PARTS`` partitions that hold correlated bits together, so that the other
   partitions are as selective as they can be (the bits' correlations are summed over all fingerprints
   in the tasks: 64 x 64 numbers);
3. two fingerprints within ``radius`` differ in some partition i by at most t_i, whenever the thresholds
   t_i >= -1 (-1: the partition is not probed) sum to ``radius - PARTS + 1``.  Every fingerprint takes
   thresholds of its own, by dynamic programming over the partitions on the estimated numbers of
   candidates: exact counts for t = 0, those of a bounded sample with the uniform expectation for more.
   Where even the best allocation costs more than naming all fingerprints within ``radius`` of the whole
   64 bits, the fingerprint does that instead (one partition with t = radius).  So no fingerprint meets
   an unbounded bucket;
4. probes join the partitions' values, and every candidate is verified on all 64 bits inside the join.
   Values of many fingerprints are dealt to salts of ``SALT_ROWS`` probes each;
5. components are joined by star steps.

The thresholds only steer the work: any allocation finds every link.

Edge cases: no words or no text: the fingerprint is zero, linked like any other; fewer words than a
shingle: the whole sequence is the one shingle; rows without a doc_id are left out; rows that share a
doc_id are one document with several fingerprints (all of them link it); repeated rows get a
row each; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachkit.llm import common as c
from reachkit.llm.common import U64
from reachkit.llm.components import connected_components, shared_id_links

SHINGLE, RADIUS, BITS, SEED = 3, 2, 64, 42
PARTS = 3
SAMPLE = 512  # fingerprints whose distances estimate the candidates of thresholds above 0
SALT_ROWS = 4096
PROBE_COST = 1.0  # a probe is a row that is shuffled
CANDIDATE_COST = 0.02  # a candidate is one comparison inside the join
_LANES = U64(0x0001000100010001)
_SEGMENT = 60_000  # shingles whose bits are counted in 16-bit lanes


# ---------------------------------------------------------------- fingerprints

def _joined(buf: np.ndarray, ws: np.ndarray, we: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space: bytes, first byte and byte after the last of every word."""
    from reachkit.llm.repeats import ranges

    size = we - ws + 1
    flat = np.append(buf, np.uint8(32))[np.minimum(ranges(ws, size), len(buf))]
    stop = np.cumsum(size)
    flat[stop - 1] = 32
    return flat.tobytes(), stop - size, stop - 1


def shingle_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, shingle: int = SHINGLE):
    """(XXH64 of every shingle, number of shingles per row), row after row."""
    from xxhash import xxh64_intdigest

    low = c.LOWER[buf]
    ws, we, row = c.words(low, start, end)
    count = np.bincount(row, minlength=len(start)).astype(np.int64)
    n = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
    if len(ws) == 0:
        return np.zeros(0, U64), n
    raw, a, b = _joined(low, ws, we)
    first = np.cumsum(count) - count
    off = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(off - first, n)  # first word of every shingle
    last = np.minimum(at + shingle - 1, np.repeat(first + count - 1, n))
    return np.fromiter((xxh64_intdigest(raw[i:j], SEED) for i, j in zip(a[at].tolist(), b[last].tolist(), strict=True)),
                       U64, len(at)), n


def fingerprints(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Majority bits of every row's hashes."""
    out = np.zeros(len(n), U64)
    some = np.flatnonzero(n)
    if len(some) == 0:
        return out
    # bits are counted in four 16-bit lanes at once, in segments that cannot overflow a lane
    pieces = -(-n[some] // _SEGMENT)
    row = np.repeat(np.arange(len(some)), pieces)
    begin = np.cumsum(n[some]) - n[some]
    inside = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = begin[row] + inside * _SEGMENT
    first = np.cumsum(pieces) - pieces
    for shift in range(16):
        lanes = np.add.reduceat(hashes >> U64(shift) & _LANES, cuts)
        for lane in range(4):
            held = np.add.reduceat((lanes >> U64(16 * lane) & U64(0xFFFF)).astype(np.int64), first)
            out[some] |= (2 * held > n[some]).astype(U64) << U64(16 * lane + shift)
    return out


def signed(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a long) of every row with a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, buf, start, end in c.text_slices(batches):
            fp = fingerprints(*shingle_hashes(buf, start, end, shingle))
            yield pa.RecordBatch.from_arrays([ids, pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    texts = c.documents(docs).where("doc_id is not null")
    return c.stored(c.mapped(texts, run, "doc_id long, fp long"), "simhash-signed")


# ---------------------------------------------------------------- partitions and thresholds

def _bit_matrix(fp: np.ndarray) -> np.ndarray:
    return (fp[:, None] >> np.arange(BITS, dtype=U64) & U64(1)).astype(np.float64)


def bit_sums(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """(fingerprints, 64 x 64 numbers of fingerprints that hold both bits), summed in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            bits = _bit_matrix(c.column(batch, "fp").to_numpy().view(U64))
            total += bits.T @ bits
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a * BITS + b), pa.array(total[a, b].astype(np.int64))], ["at", "n"])

    rows = distinct.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS)
    for r in rows:  # at most 64 x 64
        both[r["at"]] = r["n"]
    return distinct.count(), both.reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Bits grouped into partitions of about equal size: each starts from the two most correlated bits
    left and takes the bit with the largest mean correlation to its own, until it is full."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(near, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        sub = near[np.ix_(left, left)]
        mine = [left[int(sub.sum(1).argmax())]] if size else []
        while len(mine) < size:
            rest = [b for b in left if b not in mine]
            mine.append(rest[int(near[np.ix_(rest, mine)].mean(1).argmax())])
        out.append(sorted(mine))
        left = [b for b in left if b not in mine]
    return out


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _as_long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _flips(bits: list[int], most: int) -> list[np.ndarray]:
    """Flip masks of 0, 1, .. ``most`` of the bits."""
    return [np.array([_mask(x) for x in combinations(bits, t)], U64) for t in range(most + 1)]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def allocate(cost: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest thresholds by dynamic programming: ``cost[q, i, t + 1]`` of threshold t >= -1 of
    partition i.  Returns (thresholds [q, i] with sum ``total``, their cost)."""
    n, parts, width = cost.shape
    lowest, sums = -parts, total + parts + 1  # partial sums lie between -parts and total + (parts left)
    best = np.full((n, sums + parts + 1), np.inf)
    best[:, -lowest] = 0.0  # the empty sum
    back = []
    for i in range(parts):
        now, choice = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for t in range(-1, width - 1):
            moved = np.full_like(best, np.inf)
            if t < 0:
                moved[:, :-1] = best[:, 1:]
            else:
                moved[:, t:] = best[:, :best.shape[1] - t]
            moved += cost[:, i, t + 1][:, None]
            better = moved < now
            now, choice = np.where(better, moved, now), np.where(better, np.int8(t), choice)
        best = now
        back.append(choice)
    at = np.full(n, total - lowest)
    value = best[np.arange(n), at]
    out = np.zeros((n, parts), np.int64)
    for i in range(parts - 1, -1, -1):
        out[:, i] = back[i][np.arange(n), at]
        at = at - out[:, i]
    return out, value


def _probes(counted: DataFrame, parts: list[list[int]], sample: np.ndarray, n: int, radius: int) -> DataFrame:
    """``part, value, fp``: the probes of every fingerprint of ``counted(fp, counts)``; part -1 names
    whole fingerprints."""
    total = radius - len(parts) + 1
    most = min(radius, max(total + len(parts) - 1, 0))
    masks = np.array([_mask(p) for p in parts], U64)
    flips = [_flips(p, most) for p in parts]
    whole = np.concatenate(_flips(list(range(BITS)), radius)[1:])
    # what a partition's ball of radius t holds of n uniform fingerprints
    uniform = np.array([[n * sum(comb(len(p), k) for k in range(t + 1)) / 2.0 ** len(p) for t in range(most + 1)] for p in parts])
    size = np.array([[sum(comb(len(p), k) for k in range(t + 1)) for t in range(most + 1)] for p in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                fp = c.column(part, "fp").to_numpy().view(U64)
                counts = np.stack([c.column(part, f"n{k}").to_numpy() for k in range(len(parts))], 1)
                cost = np.zeros((len(fp), len(parts), most + 2))
                for k, mask in enumerate(masks):
                    apart = _popcount((fp[:, None] ^ sample[None, :]) & mask)
                    for t in range(most + 1):
                        held = counts[:, k] if t == 0 else np.maximum(
                            counts[:, k] + uniform[k, t], (apart <= t).sum(1) * (n / max(len(sample), 1)))
                        cost[:, k, t + 1] = PROBE_COST * size[k, t] + CANDIDATE_COST * held
                chosen, value = allocate(cost, total)
                everywhere = value > PROBE_COST * len(whole)
                for k, mask in enumerate(masks):
                    for t in range(most + 1):
                        q = fp[~everywhere & (chosen[:, k] >= t)]
                        if len(q):
                            near = ((q & mask)[:, None] ^ flips[k][t][None, :]).reshape(-1)
                            yield _rows(k, near, np.repeat(q, len(flips[k][t])))
                q = fp[everywhere]
                for j in range(0, len(q), 64):
                    near = (q[j:j + 64, None] ^ whole[None, :]).reshape(-1)
                    yield _rows(-1, near, np.repeat(q[j:j + 64], len(whole)))

    return counted.mapInArrow(run, "part int, value long, fp long")


def _rows(part: int, value: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), part, np.int32)), pa.array(value.view(np.int64)),
                                       pa.array(fp.view(np.int64))], ["part", "value", "fp"])


def _by_part(distinct: DataFrame, parts: list[list[int]]) -> DataFrame:
    """``part, value, fp``: the value of every fingerprint in every partition."""
    values = [F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_as_long(_mask(p)))).alias("value"))
              for k, p in enumerate(parts)]
    return distinct.select("fp", F.explode(F.array(*values)).alias("x")).select("x.part", "x.value", "fp")


def near_pairs(distinct: DataFrame, radius: int = RADIUS, n_parts: int = PARTS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``fp, other`` (fp < other): all pairs of the distinct fingerprints within ``radius`` bits."""
    n, both = bit_sums(distinct)
    parts = correlated_parts(n, both, n_parts)
    drawn = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()  # bounded: steers costs only
    sample = np.array([r["fp"] for r in drawn], np.int64).view(U64)

    placed = c.stored(_by_part(distinct, parts), "simhash-parts")
    counts = c.stored(placed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")), "simhash-counts")
    own = placed.join(counts.where("n > 1").hint("merge"), ["part", "value"])  # values of one are 1 anyway
    held = [F.coalesce(F.max(F.when(F.col("part") == k, F.col("n"))), F.lit(1)).cast("long").alias(f"n{k}") for k in range(n_parts)]
    met = own.groupBy("fp").agg(*held)
    lone = [F.coalesce(f"n{k}", F.lit(1)).cast("long").alias(f"n{k}") for k in range(n_parts)]
    counted = c.stored(distinct.select("fp").join(met.hint("merge"), "fp", "left").select("fp", *lone), "simhash-counted")
    probes = c.stored(_probes(counted, parts, sample, n, radius), "simhash-probes")

    # probes of values that no fingerprint has end here; crowded values are dealt to salts
    salts = F.ceil(F.col("n") / F.lit(salt_rows)).cast("int")
    live = probes.where("part >= 0").join(counts.hint("merge"), ["part", "value"])
    live = live.withColumn("salt", F.pmod(F.xxhash64("fp"), salts).cast("int")).drop("n")
    index = placed.withColumnRenamed("fp", "other").join(counts.hint("merge"), ["part", "value"])
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    met = live.hint("merge").join(index, ["part", "value", "salt"]).where((apart <= radius) & (F.col("fp") != F.col("other")))
    named = (probes.where("part < 0").select("fp", F.col("value").alias("other"))
             .join(distinct.select(F.col("fp").alias("other")).hint("merge"), "other"))
    pairs = met.select("fp", "other").unionByName(named.select("fp", "other"))
    return pairs.select(F.least("fp", "other").alias("fp"), F.greatest("fp", "other").alias("other")).distinct()


# ---------------------------------------------------------------- components

def _hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``."""
    mine = signed(docs, shingle)
    distinct = c.stored(mine.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    pairs = c.stored(near_pairs(distinct, radius), "simhash-pairs")
    reps = distinct.select("fp", "rep")
    links = (pairs.join(reps.withColumnRenamed("rep", "a").hint("merge"), "fp")
             .join(reps.select(F.col("fp").alias("other"), F.col("rep").alias("b")).hint("merge"), "other").select("a", "b"))
    links = links.unionByName(shared_id_links(mine, reps, ["fp"]))
    labels = c.stored(connected_components(c.stored(links, "simhash-links")), "simhash-labels")
    named = (reps.join(labels.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left")
             .select("fp", F.coalesce("component", "rep").alias("component_id")))
    named = c.stored(named, "simhash-classes")
    return mine.join(named.hint("merge"), "fp").select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return components(docs)

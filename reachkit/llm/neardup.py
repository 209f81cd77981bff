"""MinHash near-dedup with sequential Bayesian verification.

A document's set is its distinct shingles of ``shingle`` words.  Two documents are linked if their
sets' Jaccard similarity is at least ``threshold``; a component is what links reach.

1. one pass over the texts: set size, a 128-bit set hash and a signature of minimum hashes;
2. documents with equal sets collapse to one class (combined map-side), numbered in its written table;
3. bands of the signature deal classes into buckets;
4. inside a bucket's task, candidates are compared by batches of signature values; after each batch a
   pair whose posterior probability of reaching the threshold is below ``miss`` is pruned (uniform
   prior).  At first only a heaviest forest of the survivors (by matches) leaves the task: fewer links
   than members, the likeliest ones; they are verified on the full sets and joined by star steps;
5. in buckets that still hold several components, every pair of different components is compared on
   ``MORE`` further values as well, and every survivor is verified on the full sets.  In a bucket with more
   than ``DENSE`` survivors a row (documents just below the threshold), the full sets come into the task once
   per class and only confirmed links leave it, reduced to a forest: its pairs are never rows.  So no pair of
   a bucket is lost;
6. links join documents: the classes' smallest doc_ids, and every doc_id that lies in several classes.

A bucket of more than ``BLOCK`` rows (a crowded one of more than ``BLOCK_BYTES`` of sets) is compared in pairs
of blocks, each a group of its own.

Chance: a pair at the threshold meets in no band with probability (1 - t**rows)**bands (3e-5 for the
defaults); each Bayesian batch loses less than ``miss``.

Edge cases: without words or text a set is empty and linked with nothing; a text of fewer than
``shingle`` words is one shingle; rows without a doc_id are left out; rows sharing a doc_id are one
document with several sets: each of them links it; an empty table gives no row; extra columns are
ignored (``keep_one`` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachkit.llm import common as c
from reachkit.llm.common import U64
from reachkit.llm.components import connected_components, shared_id_links
from reachkit.llm.repeats import ranges

SHINGLE, THRESHOLD = 4, 0.8
BANDS, ROWS = 26, 5
MISS = 1e-5
STEP = 26  # signature values compared before each decision
MORE, MORE_STEP = 512, 128  # further values (one byte each) of documents in buckets, for near misses
BLOCK = 16_384  # rows of a bucket compared in one task
BLOCK_BYTES = 4 << 20  # of the sets of a crowded bucket compared in one task
GROUP_BYTES = 4 << 20  # of the sets of small crowded buckets that share a task
DENSE = 8  # surviving pairs a row from which on a bucket is crowded
CHUNK_PAIRS = 20_000  # pairs of a bucket looked at at once
SEED = 20240229


# ---------------------------------------------------------------- sets and signatures

def shingle_sets(buf, start, end, shingle: int):
    """Distinct shingles of every row as sorted 48-bit hashes: (values, row, size per row)."""
    low = c.LOWER[buf]
    ws, we, row = c.words(low, start, end)
    unit = c.word_hashes(low, ws, we)
    n = len(start)
    count, inside = c.in_row(np.arange(len(ws)), row, n)
    grams = c.rolling(unit, shingle)
    ok = np.flatnonzero(inside[:len(grams)] + shingle <= count[row[:len(grams)]]) if len(grams) else np.zeros(0, np.int64)
    value, at = grams[ok], row[ok]
    short = np.flatnonzero((count > 0) & (count < shingle))
    if len(short):  # the whole sequence as one shingle
        mark = np.isin(row, short)
        power = (inside[mark].astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
        begin = np.cumsum(count[short]) - count[short]
        one = np.add.reduceat(c.mix(unit[mark] + power), begin)
        value, at = np.concatenate([value, c.mix(one + count[short].astype(U64))]), np.concatenate([at, short])
    key = np.sort(at.astype(U64) << U64(48) | value >> U64(16))
    if len(key):
        key = np.compress(np.append(True, key[1:] != key[:-1]), key)
    at = (key >> U64(48)).astype(np.int64)
    return key & U64((1 << 48) - 1), at, np.bincount(at, minlength=n).astype(np.int64)


@cache
def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1)


def signatures(values: np.ndarray, size: np.ndarray, n_hashes: int, skip: int = 0, kind=np.uint32) -> np.ndarray:
    """Minimum hashes of the non-empty rows: ``n_hashes`` functions behind the first ``skip``."""
    begin = (np.cumsum(size) - size)[size > 0]
    out = np.zeros((len(begin), n_hashes), kind)
    if len(begin):
        x = c.mix(values + U64(SEED))
        for j, a in enumerate(_multipliers(skip + n_hashes)[skip:]):
            out[:, j] = (np.minimum.reduceat(x * a, begin) >> U64(32)).astype(kind)
    return out


def _signed(docs: DataFrame, shingle: int, n_hashes: int) -> DataFrame:
    schema = "doc_id long, tid long, n_shingles long, k1 long, k2 long, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid, done = c.column(batch, "tid"), 0
            for ids, buf, start, end in c.text_slices(iter([batch])):
                value, _, size = shingle_sets(buf, start, end, shingle)
                some = size > 0
                begin = (np.cumsum(size) - size)[some]
                keys = np.zeros((2, len(size)), U64)
                if len(begin):
                    keys[0, some] = np.add.reduceat(c.mix(value + U64(0xA0761D6478BD642F)), begin)
                    keys[1, some] = np.add.reduceat(c.mix(value ^ U64(0xE7037ED1A0B428DB)), begin)
                sig = signatures(value, size, n_hashes)
                yield pa.RecordBatch.from_arrays(
                    [ids, tid.slice(done, len(ids)), pa.array(size), pa.array(keys[0].view(np.int64)),
                     pa.array(keys[1].view(np.int64)), c.packed(sig.reshape(-1), some * n_hashes)],
                    [x.split()[0] for x in schema.split(", ")])
                done += len(ids)

    texts = c.documents(docs).where("doc_id is not null").withColumn("tid", F.xxhash64("text"))
    return c.stored(c.mapped(texts, run, schema), "neardup-signed")


def _buckets(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """``key, band, sid, m`` of the buckets with ``m`` of at least two classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = c.flat(c.column(batch, "sig"))[0].view(np.uint32).reshape(batch.num_rows, -1)
            ids = c.column(batch, "sid")
            for band in range(bands):
                part = sig[:, band * rows:(band + 1) * rows].astype(U64)
                key = np.full(len(part), band + 1, U64)
                for j in range(rows):
                    key = c.mix(key * U64(0x9E3779B97F4A7C15) + part[:, j])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), band, np.int32)), ids],
                                                 ["key", "band", "sid"])

    rows_ = c.stored(reps.select("sid", "sig").mapInArrow(run, "key long, band int, sid long"), "neardup-bands")
    many = c.stored(rows_.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "neardup-keys")
    return c.stored(rows_.join(many.hint("merge"), "key"), "neardup-buckets")


# ---------------------------------------------------------------- verification

def posterior(matches: int, n: int, threshold: float) -> float:
    """P(similarity >= threshold | matches of n values agree), uniform prior: a binomial tail."""
    m = n + 1
    return sum(math.comb(m, j) * threshold ** j * (1 - threshold) ** (m - j) for j in range(0, matches + 1))


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Matches among n values that keep a pair alive."""
    return next((m for m in range(n + 1) if posterior(m, n, threshold) >= miss), n + 1)


def max_forest(x: np.ndarray, y: np.ndarray, weight: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Edges (their numbers) of a heaviest forest that joins the labels (0..n) of the rows, by rounds in
    which every label takes its heaviest edge; ties go to the lower number, so no cycles arise."""
    label, taken = label.copy(), []
    number = np.arange(len(x))
    while True:
        a, b = label[x[number]], label[y[number]]
        number = number[a != b]
        if len(number) == 0:
            return np.unique(np.concatenate(taken)) if taken else number
        a, b = label[x[number]], label[y[number]]
        end, edge = np.concatenate([a, b]), np.concatenate([number, number])
        order = np.lexsort((edge, -weight[edge], end))
        end, edge = end[order], edge[order]
        first = np.append(True, end[1:] != end[:-1])
        end, edge = end[first], edge[first]
        taken.append(edge)
        up = np.arange(int(label.max()) + 1)
        up[end] = label[x[edge]] + label[y[edge]] - end  # the other end
        pair = up[up[end]] == end  # two labels that took the same edge: the smaller one is the root
        root = end[pair & (end < up[end])]
        up[root] = root
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def _survivors(left: np.ndarray, right: np.ndarray, same: np.ndarray, done: int, stops):
    """(number, matches) of the row pairs left[i] / right[i] that survive the batches from ``done`` values on."""
    alive = np.arange(len(same))
    for n, least in stops:
        if n > done:
            same = same + (left[alive, done:n] == right[alive, done:n]).sum(1)
            keep = np.flatnonzero(same >= least)
            alive, same, done = alive[keep], same[keep], n
    return alive, same


def _compare(sig: np.ndarray, more: np.ndarray | None, which: np.ndarray, stops, before: int,
             rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, other rows, matches) of one bucket, in different components ``which``, that survive the batches
    of signature values, and then those of ``more`` (each pair in the first band where it meets: ``before``
    bands of ``rows`` values lie ahead of this one), in batches of bounded size.  Rows of the largest
    component are met by the others, never by each other."""
    m = len(which)
    size = np.bincount(which)
    if len(size) < 2:
        return
    large = int(size.argmax())
    outside = np.flatnonzero(which != large)
    first, least = stops[0]
    values = sig.shape[1]
    step = max(1, CHUNK_PAIRS // m)
    for i in range(0, len(outside), step):
        part = outside[i:i + step]
        same = np.zeros((len(part), m), np.int16)
        for k in range(first):
            same += sig[part, k][:, None] == sig[None, :, k]
        ok = (same >= least) & (which[part][:, None] != which[None, :])
        ok &= (which[None, :] == large) | (np.arange(m)[None, :] > part[:, None])  # each pair once
        x, y = np.nonzero(ok)
        x, same = part[x], same[x, y].astype(np.int64)
        if more is not None and before:
            met = (sig[x, :before * rows] == sig[y, :before * rows]).reshape(-1, before, rows).all(2).any(1)
            x, y, same = x[~met], y[~met], same[~met]
        alive, same = _survivors(sig[x], sig[y], same, first, [s for s in stops if s[0] <= values])
        x, y = x[alive], y[alive]
        if more is not None:  # one byte each: unequal values agree once in 256, so nothing is lost
            alive, same = _survivors(more[x], more[y], same, 0, [(n - values, least) for n, least in stops if n > values])
            x, y = x[alive], y[alive]
        if len(x):
            yield x, y, same


def _forest(batches, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A heaviest forest (by matches) over the components: the forest of all edges is the forest of forests."""
    xs = ys = ws = np.zeros(0, np.int64)
    for batch in batches:
        xs, ys, ws = (np.concatenate(z) for z in zip((xs, ys, ws), batch, strict=True))
        keep = max_forest(xs, ys, ws, which)
        xs, ys, ws = xs[keep], ys[keep], ws[keep]
    return xs, ys


def _linked(batches, which: np.ndarray, sets: tuple[np.ndarray, np.ndarray, np.ndarray], mark: np.ndarray,
            up: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs whose full sets reach the threshold (``up`` millionths), over the components.
    ``sets``: numbers of shingles, first and after the last of every row; ``mark``: a false entry per number.
    Pairs that confirmed links join already are not verified."""
    flat, start, end = sets
    label, xs, ys = which.copy(), [], []
    for x, y, _ in batches:
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        cut = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(x)).tolist(), strict=True):
            one, others = int(x[lo]), y[lo:hi]
            mine = flat[start[one]:end[one]]
            mark[mine] = True
            # a bounded number of shingles at a time
            for i in range(0, len(others), 512):
                part = others[i:i + 512]
                part = part[label[part] != label[one]]
                if len(part) == 0:
                    continue
                size = end[part] - start[part]
                both = np.add.reduceat(mark[flat[ranges(start[part], size)]].astype(np.int64), np.cumsum(size) - size)
                for other in part[both * 1_000_000 >= up * (size + len(mine) - both)].tolist():
                    if label[other] != label[one]:
                        xs.append(one)
                        ys.append(other)
                        label[label == label[other]] = label[one]
            mark[mine] = False
    return np.array(xs, np.int64), np.array(ys, np.int64)


def _rows(col: pa.ChunkedArray, kind) -> np.ndarray:
    """Matrix of a binary column whose rows are equally long."""
    buf, start, end = c.flat(col)
    if len(start) == 0:
        return np.zeros((0, 1), kind)
    return buf[int(start[0]):int(end[-1])].view(kind).reshape(len(start), -1)


def _stops(threshold: float, miss: float, n_hashes: int, more: bool) -> list[tuple[int, int]]:
    """(values compared, least matches) of the batches."""
    stops = list(range(STEP, n_hashes + 1, STEP))
    if more:
        stops += list(range(n_hashes + MORE_STEP, n_hashes + MORE + 1, MORE_STEP))
    return [(n, least_matches(n, threshold, miss)) for n in stops]


def _in_buckets(table: pa.Table, pairs_of) -> pa.Table:
    """``a, b`` of the buckets of one group: ``pairs_of(rows, component numbers, band)`` of each."""
    key = table.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    sid, comp, band = (table.column(x).to_numpy()[order] for x in ("sid", "comp", "band"))
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    found = [np.zeros((0, 2), np.int64)]
    for lo, hi in zip(edge.tolist(), np.append(edge[1:], len(key)).tolist(), strict=True):
        _, which = np.unique(comp[lo:hi], return_inverse=True)
        x, y = pairs_of(order[lo:hi], which, int(band[lo]))
        found.append(np.stack([sid[lo:hi][x], sid[lo:hi][y]], 1))
    pairs = np.unique(np.sort(np.concatenate(found), 1), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def _dealt(rows: DataFrame, blocks, groups: int) -> DataFrame:
    """Small buckets share a group ``g``; one of several ``blocks`` is dealt to pairs of its blocks."""
    live = (rows.withColumn("blocks", blocks.cast("int")).withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))))
    g = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(groups))).otherwise(
        F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
    return live.select(g.alias("g"), "key", "band", "sid", "comp")


def _likely(buckets: DataFrame, sigs: DataFrame, threshold: float, miss: float, n_hashes: int, rows: int, block: int) -> DataFrame:
    """The likeliest pairs ``a, b`` of every bucket: a heaviest forest over its classes."""
    stops = _stops(threshold, miss, n_hashes, False)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sig = _rows(table.column("sig"), np.uint32)
        out = _in_buckets(table, lambda mine, which, band: _forest(_compare(sig[mine], None, which, stops, band, rows), which))
        c.release()
        return out

    groups = c.group_count(buckets.sparkSession, buckets.count(), 8192)
    live = _dealt(buckets.withColumn("comp", F.col("sid")), F.ceil(F.col("m") / F.lit(block)), groups)
    live = live.join(sigs.select("sid", "sig").hint("merge"), "sid")
    return live.groupBy("g").applyInArrow(run, "a long, b long").where("a < b").distinct()


def _mixed(buckets: DataFrame, labels: DataFrame, sigs: DataFrame) -> DataFrame:
    """The rows of buckets that still hold several components, with their component ``comp``."""
    named = buckets.join(labels.select(F.col("node").alias("sid"), F.col("component").alias("comp")).hint("merge"),
                         "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    named = c.stored(named.join(sigs.select("sid", "bytes").hint("merge"), "sid"), "neardup-named")
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("bytes").alias("held"))
    mixed = c.stored(mixed.where("lo < hi").select("key", "held"), "neardup-mixed")
    return c.stored(named.join(mixed.hint("merge"), "key"), "neardup-live")


def _rest(live: DataFrame, sigs: DataFrame, threshold: float, miss: float, n_hashes: int, rows: int, block: int) -> DataFrame:
    """``a, b`` of the pairs in different components that survive all values, and ``key`` of the buckets
    where more than ``DENSE`` a row do: those give no pairs."""
    stops = _stops(threshold, miss, n_hashes, True)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sig, more = _rows(table.column("sig"), np.uint32), _rows(table.column("more"), np.uint8)
        key, dense = table.column("key").to_numpy(), []

        def pairs(mine, which, band):
            xs, ys, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
            for x, y, _ in _compare(sig[mine], more[mine], which, stops, band, rows):
                xs.append(x)
                ys.append(y)
                n += len(x)
                if n > DENSE * len(mine):
                    dense.append(int(key[mine[0]]))
                    return xs[0], ys[0]
            return np.concatenate(xs), np.concatenate(ys)

        out = _in_buckets(table, pairs)
        out = out.append_column("key", pa.nulls(out.num_rows, pa.int64()))
        c.release()
        return pa.concat_tables([out, pa.table({"a": pa.nulls(len(dense), pa.int64()), "b": pa.nulls(len(dense), pa.int64()),
                                                "key": pa.array(dense, pa.int64())})])

    dealt = _dealt(live, F.ceil(F.col("m") / F.lit(block)), c.group_count(live.sparkSession, live.count(), 8192))
    dealt = dealt.join(sigs.select("sid", "sig", "more").hint("merge"), "sid")
    found = dealt.groupBy("g").applyInArrow(run, "a long, b long, key long")
    return c.stored(found.distinct(), "neardup-rest")


def _dense(live: DataFrame, sigs: DataFrame, threshold: float, miss: float, n_hashes: int, rows: int, block_bytes: int) -> DataFrame:
    """Confirmed links ``a, b`` of crowded buckets: the full sets come into the task, a forest leaves it."""
    stops = _stops(threshold, miss, n_hashes, True)
    up = round(threshold * 1_000_000)  # exact in integers

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sig, more = _rows(table.column("sig"), np.uint32), _rows(table.column("more"), np.uint8)
        buf, start, end = c.flat(table.column("shingles"))
        held = buf[int(start[0]):int(end[-1])].view(np.uint64) if len(start) else np.zeros(0, U64)
        flat = np.unique(held, return_inverse=True)[1].astype(np.int32)
        mark = np.zeros(len(flat), bool)
        start, end = (start - start[0]) // 8, (end - start[0]) // 8

        def pairs(mine, which, band):
            batches = _compare(sig[mine], more[mine], which, stops, band, rows)
            return _linked(batches, which, (flat, start[mine], end[mine]), mark, up)

        out = _in_buckets(table, pairs)
        c.release()
        return out

    held = live.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    dealt = _dealt(live, F.ceil(F.col("held") / F.lit(block_bytes)), c.group_count(live.sparkSession, held, GROUP_BYTES))
    dealt = dealt.join(sigs.select("sid", "sig", "more", "shingles").hint("merge"), "sid")
    return dealt.groupBy("g").applyInArrow(run, "a long, b long").where("a < b").distinct()


def _confirm(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    up = round(threshold * 1_000_000)  # exact in integers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [c.flat(c.column(batch, x)) for x in ("sa", "sb")]
            for i, j in c.row_slices(sides[0][1], sides[0][2] + (sides[1][2] - sides[1][1])):
                keys, sizes = [], []
                for buf, start, end in sides:
                    size = (end[i:j] - start[i:j]) // 8
                    row = np.repeat(np.arange(j - i, dtype=U64), size)
                    keys.append(row << U64(48) | buf[int(start[i]):int(end[j - 1])].view(np.uint64))
                    sizes.append(size)
                key = np.sort(np.concatenate(keys))
                both = np.bincount((key[1:][key[1:] == key[:-1]] >> U64(48)).astype(np.int64), minlength=j - i)
                keep = pa.array(np.flatnonzero(both * 1_000_000 >= up * (sizes[0] + sizes[1] - both)) + i)
                yield pa.RecordBatch.from_arrays([c.column(batch, x).take(keep) for x in ("a", "b")], ["a", "b"])

    met = (pairs.join(sigs.select(F.col("sid").alias("a"), F.col("shingles").alias("sa")).hint("merge"), "a")
           .join(sigs.select(F.col("sid").alias("b"), F.col("shingles").alias("sb")).hint("merge"), "b"))
    return c.mapped(met.select("a", "b", "sa", "sb"), run, "a long, b long")


# ---------------------------------------------------------------- rounds

def _full_sets(texts: DataFrame, shingle: int, skip: int) -> DataFrame:
    """``sid, more, shingles, bytes``: further signature values and the whole set of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, buf, start, end in c.text_slices(batches, "sid"):
            value, _, size = shingle_sets(buf, start, end, shingle)
            more = signatures(value, size, MORE, skip, np.uint8)
            yield pa.RecordBatch.from_arrays([ids, c.packed(more.reshape(-1), (size > 0) * MORE), c.packed(value, size),
                                              pa.array(8 * size + MORE)], ["sid", "more", "shingles", "bytes"])

    return c.mapped(texts, run, "sid long, more binary, shingles binary, bytes long")


def links(docs: DataFrame, signed: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD,
          bands: int = BANDS, rows: int = ROWS, miss: float = MISS, block: int = BLOCK,
          block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(``k1, k2, rep``: every class with its smallest doc_id; ``node, component``: what links join)."""
    reps = signed.where("n_shingles > 0").groupBy("k1", "k2").agg(
        F.min(F.struct("doc_id", "tid")).alias("least"), F.first("sig").alias("sig"))
    reps = c.stored(reps.select("k1", "k2", F.col("least.doc_id").alias("rep"), F.col("least.tid").alias("tid"), "sig",
                                F.monotonically_increasing_id().alias("sid")), "neardup-reps")  # fixed by being written
    buckets = _buckets(reps.select("sid", "sig"), bands, rows)
    inside = buckets.select("sid").distinct().join(reps.select("sid", "rep", "tid").hint("merge"), "sid")
    inside = c.stored(inside, "neardup-inside")
    own = c.documents(docs).where("doc_id is not null").withColumn("tid", F.xxhash64("text"))
    few = inside.count() <= 1 << 17  # three longs a row
    texts = own.join(F.broadcast(inside) if few else inside, (F.col("doc_id") == F.col("rep")) & (own["tid"] == inside["tid"]))
    texts = texts.select("sid", "text").dropDuplicates(["sid"])  # repeated rows
    sets = c.stored(_full_sets(texts, shingle, bands * rows), "neardup-sets")
    sigs = c.stored(reps.select("sid", "sig").join(sets.hint("merge"), "sid"), "neardup-sigs")
    likely = c.stored(_likely(buckets, sigs, threshold, miss, bands * rows, rows, block), "neardup-likely")
    first = c.stored(_confirm(likely, sigs, threshold), "neardup-first")
    labels = c.stored(connected_components(first), "neardup-labels")
    live = _mixed(buckets, labels, sigs)
    found = _rest(live, sigs, threshold, miss, bands * rows, rows, block)
    rest = _confirm(found.where("key is null and a < b").select("a", "b"), sigs, threshold)
    crowded = c.stored(found.where("key is not null").select("key").distinct(), "neardup-crowded")
    if crowded.limit(1).count():
        rest = rest.unionByName(_dense(live.join(crowded.hint("merge"), "key"), sigs, threshold, miss, bands * rows, rows, block_bytes))
    # what is joined already, as one link per class
    joined = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a != b")
    found = c.stored(joined.unionByName(rest), "neardup-links")
    # from classes to documents: the classes' smallest ids, and ids that lie in several classes
    ids = reps.select("sid", "rep")
    between = (found.join(ids.select(F.col("sid").alias("a"), F.col("rep").alias("ra")).hint("merge"), "a")
               .join(ids.select(F.col("sid").alias("b"), F.col("rep").alias("rb")).hint("merge"), "b")
               .select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    members = signed.where("n_shingles > 0").select("doc_id", "k1", "k2")
    between = between.unionByName(shared_id_links(members, reps.select("k1", "k2", "rep"), ["k1", "k2"]))
    labels = c.stored(connected_components(c.stored(between, "neardup-between")), "neardup-components")
    return reps.select("k1", "k2", "rep"), labels


def components(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, tid, n_shingles, component_id, kept``."""
    signed = _signed(docs, shingle, BANDS * ROWS)
    reps, labels = links(docs, signed, shingle, threshold)
    named = c.stored(reps.join(labels.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left")
                     .select("k1", "k2", F.coalesce("component", "rep").alias("component_id")), "neardup-classes")
    mine = signed.select("doc_id", "tid", "n_shingles", "k1", "k2")
    full = mine.where("n_shingles > 0").join(named.hint("merge"), ["k1", "k2"])
    out = full.unionByName(mine.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", "tid", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    return components(docs).drop("tid")


def keep_one(docs: DataFrame, shingle: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are the smallest id of their component, with all their columns (rows
    without a doc_id stay)."""
    gone = (components(docs, shingle, threshold).where("not kept")
            .select(F.col("doc_id").alias("__llm_id"), F.col("tid").alias("__llm_tid")).distinct())
    own = docs.withColumn("__llm_key", F.xxhash64(F.col("text").cast("string")))
    return own.join(gone.hint("merge"), (F.col("doc_id").cast("long") == F.col("__llm_id")) & (F.col("__llm_key") == F.col("__llm_tid")),
                    "left_anti").select(*docs.columns)

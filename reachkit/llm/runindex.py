"""Byte-level dedup with run-length indexes: matches of ``length`` bytes or more anywhere else.

``RunLengthIndex`` holds texts as a run-compressed Burrows-Wheeler transform: the heads of the runs,
and the suffix positions at both ends of every run (sampled run ends).  In a repetitive collection
there are far fewer runs than bytes.  Matching statistics of the texts against all other places are
streamed from the samples: where the character before a suffix equals the one before its neighbour,
the common prefix with that neighbour is one shorter than at the position before; so the lengths
fall by one from sample to sample, and only the run ends need comparing.

Spark jobs (see ``repeats``): texts are cut into pieces owned by anchors; any two equal
``length``-byte strings lie in pieces of one anchor.  Equal pieces are stored once with their number.
Distinct pieces are dealt to shards by anchor, about ``SHARD_BYTES`` each, and each shard is indexed
and streamed.  An anchor with more than ``HOT_BYTES`` of distinct pieces is cut again with longer
anchors (finally whole windows, of which each is one piece), so no shard grows with a hot group.

Edge cases: a null or empty text has no bytes; matches never cross documents; rows without a doc_id
are left out; rows sharing a doc_id are apart, and repeated rows match each other; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachkit.llm import common as c
from reachkit.llm import repeats
from reachkit.llm.common import U64

LENGTH = 400
SHARD_BYTES = 1 << 20
HOT_BYTES = 1 << 18


# ---------------------------------------------------------------- the index

_BITS = 21  # of a position in the packed sort keys; larger collections take the plain sort


def suffix_array(text: np.ndarray, stop: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Suffix order of texts that each end in a terminator of their own (0 in ``text``; terminators
    are ordered by text number).  ``stop``: position of the terminator, ``member``: text number.

    Prefix doubling.  Ranks, second ranks and positions share one 64-bit key, so each round is a plain
    sort of the positions that are still tied."""
    n = len(text)
    small = n <= 1 << _BITS
    present = np.flatnonzero(np.bincount(text, minlength=256))
    width = max(1, int(len(present) - 1).bit_length())
    code = np.zeros(256, U64)
    code[present] = np.arange(len(present))
    h = max(1, (64 - _BITS) // width) if small else 64 // width
    padded = np.concatenate([code[text], np.zeros(h, U64)])
    key = np.zeros(n, U64)
    for j in range(h):
        key <<= U64(width)
        key |= padded[j:j + n]
    near = np.flatnonzero(stop - np.arange(n) < h)  # nothing counts behind a terminator
    cut = U64(width) * (h - 1 - (stop[near] - near)).astype(U64)
    key[near] = key[near] >> cut << cut
    mask, bits = U64((1 << _BITS) - 1), U64(_BITS)
    if small:
        key <<= bits
        key |= np.arange(n, dtype=U64)
        key.sort()
        order = (key & mask).astype(np.int32)
        key >>= bits
    else:
        order = np.argsort(key).astype(np.int32)
        key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n, np.int32)
    left = (stop - np.arange(n)).astype(np.int32)  # bytes up to the terminator
    member = member.astype(np.int32)
    fresh, slot = new, np.arange(n, dtype=np.int32)
    at = order
    del key, padded
    while True:
        # groups of equal keys: their first slots are the ranks of their positions
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(slot)))
        group = np.repeat(slot[first], size)
        rank[at] = group
        tied = np.repeat(size > 1, size)
        slot, group, at = np.compress(tied, slot), np.compress(tied, group), np.compress(tied, at)
        if len(slot) == 0:
            return order.astype(np.int64)
        beyond = np.flatnonzero(left[at] < h)
        ahead = at + np.int32(h)
        ahead[beyond] = 0
        second = rank[ahead]
        second[beyond] = member[at[beyond]]
        if small:
            both = group.astype(U64)
            both <<= bits
            both |= second.astype(U64)
            both <<= bits
            both |= at.astype(U64)
            both.sort()
            at = (both & mask).astype(np.int32)
            both >>= bits
        else:
            both = group.astype(U64) << U64(32) | second.astype(U64)
            by = np.argsort(both)
            at, both = at[by], both[by]
        order[slot] = at
        fresh = np.append(True, both[1:] != both[:-1])
        h *= 2


class RunLengthIndex:
    """Run-compressed BWT of byte texts, with suffix positions sampled at the ends of its runs."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray):
        size = end - start + 1
        self.first = np.cumsum(size) - size
        self.size = size
        n = int(size.sum())
        text = np.zeros(n, np.uint8)
        body = np.ones(n, bool)
        body[self.first + size - 1] = False
        text[np.flatnonzero(body)] = buf[repeats.ranges(start, end - start)] + np.uint8(1)  # UTF-8 has no 0xFF
        self.member = np.repeat(np.arange(len(size)), size)
        self.stop = (self.first + size - 1)[self.member]
        self.n = n
        order = suffix_array(text, self.stop, self.member)
        before = np.where(order == self.first[self.member[order]], np.uint8(0), text[order - 1])
        # terminators differ from each other, so each is a run of its own
        new = np.append(True, (before[1:] != before[:-1]) | (before[1:] == 0))
        head = np.flatnonzero(new)
        tail = np.append(head[1:], n) - 1
        self.symbols, self.heads = before[head], head
        self.at_head, self.at_tail = order[head], order[tail]  # sampled run ends
        # neighbours across run ends: the only places where common prefixes must be compared
        self.above = order[np.maximum(head - 1, 0)]
        self.below = order[np.minimum(tail + 1, n - 1)]
        self.text = text
        self.counts = np.bincount(text, minlength=256)

    def _common(self, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
        """Lengths of common prefixes, never beyond a terminator (binary search on rolling hashes);
        0 for those shorter than ``least``."""
        prefix = np.zeros(self.n + 1, U64)
        np.cumsum(c._BYTE[self.text] * c._WORD.to(self.n), out=prefix[1:])
        back = c._WORD.back(self.n)

        def same(x, y, size):
            return (prefix[x + size] - prefix[x]) * back[x] == (prefix[y + size] - prefix[y]) * back[y]

        out = np.zeros(len(a), np.int64)
        most = np.minimum(self.stop[a] - a, self.stop[b] - b)
        long = np.flatnonzero(most >= least)
        long = long[same(a[long], b[long], least)]
        a, b, lo, hi = a[long], b[long], np.full(len(long), least), most[long]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if len(open_) == 0:
                out[long] = lo
                return out
            mid = (lo[open_] + hi[open_] + 1) >> 1
            yes = same(a[open_], b[open_], mid)
            lo[open_] = np.where(yes, mid, lo[open_])
            hi[open_] = np.where(yes, hi[open_], mid - 1)

    def matching_statistics(self, least: int = 1) -> np.ndarray:
        """For every position the longest match that starts at another position (terminators: 0).
        Only lengths of at least ``least`` are exact; shorter ones may come out smaller."""
        best = np.zeros(self.n, np.int64)
        for sample, other, edge in ((self.at_head, self.above, self.heads == 0),
                                    (self.at_tail, self.below, np.append(self.heads[1:], self.n) == self.n)):
            length = self._common(sample, other, least)
            length[edge] = 0
            by = np.argsort(sample)
            where, length = sample[by], length[by]
            # streamed: from a sample on, the length falls by one per position up to the next sample
            # (the first position is the head and the tail of a run)
            gap = np.diff(np.append(where, self.n))
            np.maximum(best, np.repeat(length + where, gap) - np.arange(self.n), out=best)
        return best

    def count(self, pattern: bytes) -> int:
        """Occurrences of a pattern, by backward search over the runs."""
        smaller = np.cumsum(self.counts) - self.counts
        size = np.diff(np.append(self.heads, self.n))
        lo, hi = 0, self.n
        for ch in reversed(pattern):
            mine = np.flatnonzero(self.symbols == ch + 1)
            heads, have = self.heads[mine], np.append(0, np.cumsum(size[mine]))

            def rank(i, heads=heads, have=have, mine=mine):
                k = int(np.searchsorted(heads, i, "left"))  # runs that begin before i
                return 0 if k == 0 else int(have[k - 1] + min(i - heads[k - 1], size[mine[k - 1]]))

            lo, hi = int(smaller[ch + 1]) + rank(lo), int(smaller[ch + 1]) + rank(hi)
            if lo >= hi:
                return 0
        return hi - lo


# ---------------------------------------------------------------- Spark jobs

def _units(buf, start, end):
    n = len(buf)
    row = np.repeat(np.arange(len(start)), end - start)
    return c._BYTE[buf], row, n


def _grams(length: int) -> list[int]:
    """Anchor lengths of the levels: short anchors own many windows, the last own one each."""
    return [max(1, length // 6), max(1, length - length // 6), length]


def _payload(length: int):
    def payload(buf, _where, _unit, begin, run):
        size = run + length - 1
        return buf[repeats.ranges(begin, size)], size, c.word_hashes(buf, begin, begin + size)
    return payload


def _index_shards(pieces: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """``anchor, content, spans`` of the pieces that hold repeated strings: intervals of bytes."""
    held = pieces.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("b")).first()["b"]
    shards = c.group_count(pieces.sparkSession, held, shard_bytes)

    def stream(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        buf, start, end = c.flat(table.column("payload"))
        index = RunLengthIndex(buf, start, end)
        best = index.matching_statistics(length)
        copies = table.column("n").to_numpy() > 1
        rest = index.stop - np.arange(index.n)
        best = np.where(copies[index.member], rest, best)  # a copy elsewhere matches in full
        hit = np.flatnonzero((best >= length) & (rest >= length))
        member = index.member[hit]
        inside = hit - index.first[member]
        cut = np.append(True, (member[1:] != member[:-1]) | (inside[1:] - inside[:-1] > length)) if len(hit) else np.zeros(0, bool)
        a = np.flatnonzero(cut)
        b = np.append(a[1:], len(hit)) - 1
        count = np.bincount(member[a], minlength=len(start))
        some = np.flatnonzero(count)
        flat = np.stack([inside[a], inside[b] + length], 1).astype(np.int32).reshape(-1) if len(a) else np.zeros(0, np.int32)
        return pa.table({"anchor": table.column("anchor").take(pa.array(some)),
                         "content": table.column("content").take(pa.array(some)),
                         "spans": c.lists(pa.array(flat), 2 * count[some])})

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(stream, "anchor long, content long, spans array<int>")


def _resolve(pieces: DataFrame, length: int, level: int, shard_bytes: int, hot_bytes: int) -> DataFrame:
    """Spans of distinct pieces ``anchor, content, n, payload``; hot anchors go down one level."""
    grams = _grams(length)
    if level == len(grams) - 1:
        return _index_shards(pieces, length, shard_bytes)
    heavy = (pieces.groupBy("anchor").agg(F.sum(F.octet_length("payload")).alias("b")).where(F.col("b") > hot_bytes)
             .select("anchor"))
    heavy = c.stored(heavy, "runindex-hot")
    if heavy.limit(1).count() == 0:
        return _index_shards(pieces, length, shard_bytes)
    cold = _index_shards(pieces.join(heavy.hint("merge"), "anchor", "left_anti"), length, shard_bytes)

    # hot pieces are texts of their own: cut again at longer anchors that two of them share
    hot = c.stored(pieces.join(heavy.hint("merge"), "anchor"), "runindex-hot-pieces")
    texts = hot.select(F.col("anchor").alias("doc_id"), F.col("content").alias("tid"), F.col("payload").alias("text"))
    shared = repeats.shared_anchors(texts, _units, grams[level + 1], length, twice=True, name="runindex-sub")
    sub = repeats.pieces(texts, shared, _units, grams[level + 1], length, _payload(length), "runindex-sub")
    found = c.stored(_resolve(_distinct(sub, "runindex-sub"), length, level + 1, shard_bytes, hot_bytes), "runindex-sub-spans")
    back = (sub.select("doc_id", "tid", "pos", "anchor", "content").join(found.hint("merge"), ["anchor", "content"])
            .select("doc_id", "tid", F.expr("transform(spans, x -> x + pos)").alias("spans")))
    # a piece that has copies is repeated in whole
    whole = hot.where("n > 1").select(F.col("anchor").alias("doc_id"), F.col("content").alias("tid"),
                                      F.array(F.lit(0), F.octet_length("payload")).alias("spans"))
    back = back.unionByName(whole).groupBy("doc_id", "tid").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return cold.unionByName(back.select(F.col("doc_id").alias("anchor"), F.col("tid").alias("content"), "spans"))


def _distinct(found: DataFrame, name: str) -> DataFrame:
    """Equal pieces once, with their number."""
    return c.stored(found.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("n"), F.first("payload").alias("payload")), f"{name}-distinct")


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES,
                   hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``doc_id, tid, spans``: flat list of byte intervals [a, b) covered by repeated strings."""
    k = _grams(length)[0]
    texts = repeats.keyed(docs)
    shared = repeats.shared_anchors(texts, _units, k, length, twice=True, name="runindex")
    found = repeats.pieces(texts, shared, _units, k, length, _payload(length), "runindex")
    spans = c.stored(_resolve(_distinct(found, "runindex"), length, 0, shard_bytes, hot_bytes), "runindex-spans")
    mine = found.select("anchor", "content", "doc_id", "tid", "pos").join(spans.hint("merge"), ["anchor", "content"])
    mine = mine.select("doc_id", "tid", F.expr("transform(spans, x -> x + pos)").alias("spans"))
    # repeated rows (same id and text) give the same spans: a set, combined map-side, holds them once
    return mine.groupBy("doc_id", "tid").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    joined = repeats.keyed(docs).join(repeated_spans(docs, length), ["doc_id", "tid"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, done = c.column(batch, "spans"), 0
            for ids, buf, start, end in c.text_slices(iter([batch])):
                part = spans.slice(done, len(ids))
                size = np.diff(part.offsets.to_numpy()).astype(np.int64) if len(part) else np.zeros(0, np.int64)
                flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                size = np.where(part.is_valid().to_numpy(zero_copy_only=False), size, 0)
                base = np.repeat(start, size)
                step = np.zeros(len(buf) + 1, np.int64)
                np.add.at(step, base[0::2] + flat[0::2], 1)
                np.add.at(step, base[1::2] + flat[1::2], -1)
                gone = np.cumsum(step[:-1]) > 0
                row = np.repeat(np.arange(len(ids)), end - start)
                opens = gone.copy()
                opens[1:] &= ~gone[:-1] | (row[1:] != row[:-1])
                removed = np.bincount(row, weights=gone, minlength=len(ids)).astype(np.int64)
                runs = np.bincount(row, weights=opens, minlength=len(ids)).astype(np.int64)
                kept = np.compress(~gone, buf).tobytes()
                left = np.cumsum(end - start - removed)
                sha = [hashlib.sha256(kept[b - t:b]).hexdigest()
                       for b, t in zip(left.tolist(), (end - start - removed).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(end - start), pa.array(removed), pa.array(runs), pa.array(sha)],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
                done += len(ids)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return c.stored(c.mapped(joined, cut, schema), "runindex-digest")

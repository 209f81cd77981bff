"""Spelling variants with a frequency-vector trie.

Words are the lower-cased (A-Z only) maximal runs of letters A-Z, a-z and U+00C0-U+00FF, of at least
``length`` code points, that occur at least ``least`` times.  In about one of ``SLIP`` occurrences a code
point is dropped, by a hash of document and run.  Two words are near if they differ by exactly one
inserted, deleted or replaced code point.  A word's form is its near word of largest n (ties: the smallest
in code-point order) if that n is at least ``ratio`` times the word's; its root is the end of the forms.

1. one pass over the texts counts the words, combined in the tasks and then by Spark;
2. letters are dealt to ``GROUPS`` groups of about equal weight (by the vocabulary's own letter counts); a
   word's frequency vector holds its number of letters per group.  One edit adds at most one letter to a
   group and takes at most one from a group: the vectors of near words differ by a surplus of at most
   one and a deficit of at most one;
3. words are arranged by successive counts.  The first ``PREFIX`` counts deal them to Spark groups: a word
   lies in the group of its own prefix and looks into the groups whose prefixes are within the budget.
   Each pair is sought once, from the smaller prefix.  Small groups share a task; a prefix of more than
   ``BLOCK`` words is dealt to blocks of words and blocks of seekers that meet pair by pair;
4. inside a task a trie holds the counts that follow; a depth-first search goes down with all seekers of
   a node that can still pay, spending the surplus and the deficit; the words at the leaves are verified
   code point by code point;
5. forms come from one aggregate over the near pairs, roots from doubling steps over the forms.

Edge cases: null or empty texts hold no words; rows without a doc_id are left out; repeated rows count
again; runs of any length are whole words; U+00D7 and U+00F7 count as letters (they
lie in the range); an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachkit.llm import common as c
from reachkit.llm.common import U64
from reachkit.llm.repeats import ranges

LENGTH, LEAST, RATIO, SLIP = 6, 5, 5, 199
GROUPS = 12  # letter groups: levels of the trie
PREFIX = 4  # levels that deal the words to Spark groups
BLOCK = 20_000  # words, and seekers, of a block
TASK_ROWS = 20_000  # rows of the small groups that share a task
SLICE = 4 << 20
PAIR_BYTES = 8 << 20  # of candidate pairs that are verified at once
_LEAD = 0xC3  # first byte of U+00C0 - U+00FF in UTF-8
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[_LEAD] = True


# ---------------------------------------------------------------- words

def _crc_table() -> np.ndarray:
    """Byte table of the reflected CRC-32 with polynomial 0xEDB88320, by its rule."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def runs(buf: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(first byte, byte after the last, row) of the maximal runs of letters."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    mine = _LETTER[buf]
    mine[1:] |= buf[:-1] == _LEAD
    edge = np.zeros(len(buf) + 1, bool)
    edge[start[start < len(buf)]] = True
    first = mine.copy()
    first[1:] &= ~mine[:-1] | edge[1:-1]
    last = mine.copy()
    last[:-1] &= ~mine[1:] | edge[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return a, b, np.searchsorted(start, a, "right") - 1


def crc_of_runs(buf: np.ndarray, a: np.ndarray, b: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of every run, continued from the CRC ``before`` it: byte by byte over all runs at once (the
    long ones with zlib)."""
    size = b - a
    out = np.empty(len(a), np.uint32)
    for i in np.flatnonzero(size > 64).tolist():
        out[i] = zlib.crc32(buf[a[i]:b[i]].tobytes(), int(before[i]))
    short = np.flatnonzero(size <= 64)
    short = short[np.argsort(-size[short], kind="stable")]
    state = ~before[short]
    at, reach = a[short], np.searchsorted(-size[short], -np.arange(1, 65), "right")  # runs of k bytes or more
    for k in range(64):
        n = int(reach[k])
        if n == 0:
            break
        state[:n] = _CRC[(state[:n] ^ buf[at[:n] + k]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    out[short] = ~state
    return out


def _counted(docs: DataFrame, length: int) -> DataFrame:
    """``word, n``: every word's occurrences per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, list[bytes]]] = []
        size = 0
        for ids, buf, start, end in c.text_slices(batches, most=SLICE):
            low = c.LOWER[buf]
            a, b, row = runs(low, start, end)
            if len(a) == 0:
                continue
            heads = np.array([zlib.crc32(f"{i}:".encode()) for i in ids.to_pylist()], np.uint32)
            h = crc_of_runs(low, a, b, heads[row])
            lead = np.concatenate([[0], np.cumsum(low == _LEAD)])
            points = b - a - (lead[b] - lead[a])
            slip = np.flatnonzero((h % SLIP == 0) & (points > length))  # the others are too short once cut
            keep = (h % SLIP != 0) & (points >= length)
            a_, b_ = a[keep], b[keep]
            value, first, n = np.unique(c.word_hashes(low, a_, b_), return_index=True, return_counts=True)
            raw = low.tobytes()
            words = [raw[i:j] for i, j in zip(a_[first].tolist(), b_[first].tolist(), strict=True)]
            cut = []
            for i in slip.tolist():
                word = raw[a[i]:b[i]].decode()
                at = int(h[i]) % len(word)
                cut.append((word[:at] + word[at + 1:]).encode())
            held.append((value, n, words))
            size += len(words)
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()).cast(pa.string()), pa.array(np.ones(len(cut), np.int64))],
                                                 ["word", "n"])
            if size > 200_000:
                yield from _merged(held)
                held, size = [], 0
        yield from _merged(held)

    texts = c.documents(docs).where("doc_id is not null and text is not null")
    per_task = c.mapped(texts, run, "word string, n long")
    return per_task.groupBy("word").agg(F.sum("n").alias("n"))


def _merged(held) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    value = np.concatenate([x[0] for x in held])
    words = [w for x in held for w in x[2]]
    value, first, inverse = np.unique(value, return_index=True, return_inverse=True)
    n = np.bincount(inverse, weights=np.concatenate([x[1] for x in held])).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in first.tolist()], pa.binary()).cast(pa.string()), pa.array(n)],
                                     ["word", "n"])


def vocabulary(docs: DataFrame, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """``word, n``: the words of at least ``length`` code points and ``least`` occurrences."""
    return c.stored(_counted(docs, length).where(F.col("n") >= least), "spelling-words")


# ---------------------------------------------------------------- frequency vectors

def letter_groups(vocab: DataFrame, groups: int = GROUPS) -> np.ndarray:
    """Group of every code point 0-255: the vocabulary's letters, counted in Spark (at most 256 rows), are
    dealt heaviest first to the lightest group."""
    letters = vocab.select(F.explode(F.split("word", "")).alias("ch")).where("ch != ''").groupBy("ch").count().collect()
    weight, out = np.zeros(groups), np.arange(256, dtype=np.int8) % groups
    for ch, n in sorted(((r["ch"], r["count"]) for r in letters), key=lambda x: (-x[1], x[0])):
        out[ord(ch)] = int(weight.argmin())
        weight[out[ord(ch)]] += n
    return out


def vectors(words: list[str], group: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Frequency vectors: letters of every group in every word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    row = np.repeat(np.arange(len(words)), size)
    return np.bincount(row * groups + group[flat], minlength=len(words) * groups).reshape(-1, groups).astype(np.int32)


def _neighbours(prefix: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
    """The prefix and those within a surplus and a deficit of one each, none of them smaller."""
    yield prefix
    for i in range(len(prefix)):
        up = (*prefix[:i], prefix[i] + 1, *prefix[i + 1:])
        yield up
        for j in range(i + 1, len(prefix)):  # the first difference is the surplus: a larger prefix
            if up[j]:
                yield (*up[:j], up[j] - 1, *up[j + 1:])


# ---------------------------------------------------------------- the trie

def is_near(pairs_a: list[bytes], pairs_b: list[bytes]) -> np.ndarray:
    """Whether latin-1 words differ by exactly one inserted, deleted or replaced code point."""
    na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (pairs_a, pairs_b))
    out = np.zeros(len(na), bool)
    close = np.flatnonzero(np.abs(na - nb) <= 1)
    close = close[np.argsort(np.maximum(na, nb)[close], kind="stable")]
    i = 0
    while i < len(close):
        # rows of about one length, as many as fit the bound (one pair at least)
        longest = np.maximum(na, nb)[close[i:i + (PAIR_BYTES >> 3)]]
        j = i + max(1, int(np.searchsorted(longest * np.arange(1, len(longest) + 1), PAIR_BYTES, "right")))
        at = close[i:j]
        width = int(longest[j - i - 1])
        a, b = (np.frombuffer(b"".join(x[k].ljust(width, b"\0") for k in at.tolist()), np.uint8).reshape(-1, width)
                for x in (pairs_a, pairs_b))
        differ = a != b
        any_, shorter = differ.any(1), np.minimum(na, nb)[at]
        front = np.where(any_, differ.argmax(1), width)
        equal = na[at] == nb[at]
        one = differ.sum(1) == 1
        # a longer word without its code point at the first difference is the shorter word
        rest = np.arange(width)[None, :] >= front[:, None]
        long_ = np.where((na > nb)[at][:, None], a, b)
        short_ = np.where((na > nb)[at][:, None], b, a)
        ahead = np.concatenate([long_[:, 1:], np.zeros((len(at), 1), np.uint8)], 1)
        gap = ((ahead == short_) | ~rest).all(1) & (front <= shorter)
        out[at] = np.where(equal, one, gap)
        i = j
    return out


class Trie:
    """Words under their frequency vectors: level k of the trie is the count of letter group k."""

    def __init__(self, vector: np.ndarray):
        self.order = np.lexsort(vector.T[::-1])
        self.vector = vector[self.order]

    def search(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, word numbers) at the leaves that the queries reach within their budgets, depth
        first; a node is visited once, by all queries that can still pay."""
        depth = queries.shape[1]
        stack = [(0, 0, len(self.vector), np.arange(len(queries)), np.ones(len(queries), np.int8), np.ones(len(queries), np.int8))]
        while stack:
            level, lo, hi, who, surplus, deficit = stack.pop()
            if level == depth:
                yield who, self.order[lo:hi]
                continue
            column = self.vector[lo:hi, level]
            edge = np.flatnonzero(np.append(True, column[1:] != column[:-1])) if hi > lo else np.zeros(0, np.int64)
            mine = queries[who, level]
            for a, b in zip(edge.tolist(), np.append(edge[1:], hi - lo).tolist(), strict=True):
                more = column[a] - mine
                keep = np.flatnonzero((more <= surplus) & (-more <= deficit))
                if len(keep):
                    paid = more[keep]
                    stack.append((level + 1, lo + a, lo + b, who[keep], (surplus[keep] - np.maximum(paid, 0)).astype(np.int8),
                                  (deficit[keep] + np.minimum(paid, 0)).astype(np.int8)))


def _search(words: list[bytes], word_vec: np.ndarray, seekers: list[bytes], seek_vec: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(seeker numbers, word numbers) of the verified near pairs, in bounded batches."""
    qs, ws, held = [], [], 0

    def verified():
        q, w = (np.concatenate(x) for x in (qs, ws))
        ok = is_near([seekers[i] for i in q.tolist()], [words[i] for i in w.tolist()])
        return q[ok], w[ok]

    for who, leaf in Trie(word_vec).search(seek_vec):
        step = max(1, 200_000 // len(leaf))
        for i in range(0, len(who), step):
            part = who[i:i + step]
            qs.append(np.repeat(part, len(leaf)))
            ws.append(np.tile(leaf, len(part)))
            held += len(part) * len(leaf)
            if held > 200_000:
                yield verified()
                qs, ws, held = [], [], 0
    if qs:
        yield verified()


# ---------------------------------------------------------------- Spark jobs

def _key(prefix) -> int:
    """64-bit hash of a prefix of counts."""
    out = 0
    for x in prefix:
        out = (out * 0x9E3779B97F4A7C15 + int(x) + 1) & 0xFFFFFFFFFFFFFFFF
        out ^= out >> 29
    return out - (1 << 64) if out >> 63 else out


PLACED = "word string, n long, vec binary, own boolean, key long, first boolean"


def near_pairs(vocab: DataFrame, groups: int = GROUPS, prefix: int = PREFIX, block: int = BLOCK,
               task_rows: int = TASK_ROWS) -> DataFrame:
    """``a, b, na, nb``: every pair of near words once."""
    group = letter_groups(vocab, groups)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[tuple[int, ...], list[int]] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                words = c.column(part, "word").to_pylist()
                vec = vectors(words, group, groups)
                at, key = [], []
                for k, head in enumerate(map(tuple, vec[:, :prefix].tolist())):
                    if head not in keys:
                        if len(keys) > 100_000:
                            keys.clear()
                        keys[head] = [_key(x) for x in _neighbours(head)]
                    near = keys[head]
                    at.extend([k] * (len(near) + 1))
                    key.extend([near[0], *near])
                first = np.append(True, np.diff(at) != 0)  # a word's own row, then the rows that seek
                seek_own = np.append(False, first[:-1])
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [c.column(part, "word").take(take), c.column(part, "n").take(take),
                     c.packed(vec.reshape(-1).astype("<i4"), np.full(len(words), groups)).take(take),
                     pa.array(first), pa.array(key, pa.int64()), pa.array(seek_own)], [x.split()[0] for x in PLACED.split(", ")])

    placed = c.stored(vocab.select("word", "n").mapInArrow(place, PLACED), "spelling-placed")
    held = placed.groupBy("key").agg(F.sum(F.col("own").cast("long")).alias("words"), F.sum((~F.col("own")).cast("long")).alias("seekers"))
    held = c.stored(held.where("words > 0"), "spelling-groups")
    rows = placed.count()
    tasks = c.group_count(vocab.sparkSession, rows, task_rows)
    live = placed.join(held.hint("merge"), "key")  # seekers of prefixes that no word has end here
    wb, sb = (F.ceil(F.col(x) / F.lit(block)).cast("int") for x in ("words", "seekers"))
    spread = F.xxhash64("word")
    live = live.withColumn("wb", F.when(F.col("own"), F.array(F.pmod(spread, wb).cast("int"))).otherwise(F.sequence(F.lit(0), wb - 1)))
    live = live.withColumn("sb", F.when(~F.col("own"), F.array(F.pmod(spread, sb).cast("int"))).otherwise(F.sequence(F.lit(0), sb - 1)))
    small = (F.col("words") + F.col("seekers")) <= block
    live = live.withColumn("wb", F.explode("wb")).withColumn("sb", F.explode("sb"))
    live = live.withColumn("g", F.when(small, F.pmod(F.xxhash64("key"), F.lit(tasks))).otherwise(F.xxhash64("key", "wb", "sb")))

    def seek(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        key = table.column("key").to_numpy()
        own = table.column("own").to_numpy(zero_copy_only=False)
        first = table.column("first").to_numpy(zero_copy_only=False)
        n = table.column("n").to_numpy()
        words = table.column("word").to_pylist()
        raw = [w.encode("latin-1") for w in words]
        buf, start, end = c.flat(table.column("vec"))
        vec = buf[int(start[0]):int(end[-1])].view("<i4").reshape(-1, groups) if len(start) else np.zeros((0, groups), np.int32)
        order = np.lexsort((~own, key))
        cuts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(order) else np.zeros(0, np.int64)
        for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(order)).tolist(), strict=True):
            mine = order[lo:hi]
            w, s = mine[own[mine]], mine[~own[mine]]
            if len(w) == 0 or len(s) == 0:
                continue
            for q, x in _search([raw[i] for i in w], vec[w], [raw[i] for i in s], vec[s]):
                a, b = s[q], w[x]
                # inside one prefix both words seek each other: once is enough
                keep = np.array([not first[i] or words[i] < words[j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], bool)
                a, b = a[keep], b[keep]
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in a], pa.string()), pa.array([words[i] for i in b], pa.string()),
                                                  pa.array(n[a]), pa.array(n[b])], ["a", "b", "na", "nb"])

    def group_of(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(seek(table)), schema=pa.schema(
            [("a", pa.string()), ("b", pa.string()), ("na", pa.int64()), ("nb", pa.int64())]))

    live = live.select("g", "key", "word", "n", "vec", "own", "first")
    return c.stored(live.groupBy("g").applyInArrow(group_of, "a string, b string, na long, nb long"), "spelling-near")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of all words with a form, by doubling: n rises by the ratio from form to form, so few
    steps reach the end."""
    now = c.stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = c.stored(now.join(ahead.hint("merge"), "root", "left")
                        .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = step.select("word", "root")
        if step.where("moved").limit(1).count() == 0:
            return now


def variants(docs: DataFrame, length: int = LENGTH, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``."""
    vocab = vocabulary(docs, length, least)
    pairs = near_pairs(vocab)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionAll(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    # strings compare by UTF-8 bytes, which is code-point order
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    best = c.stored(vocab.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.m") >= ratio * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.m")).alias("form_n"))).alias("f")),
        "spelling-best").select("word", "n", "n_near", "f.form", "f.form_n")
    ends = roots(best.where("form is not null"))
    out = best.join(ends.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    return variants(docs)

"""Substring dedup: Rabin-Karp hashes of fixed-length word windows, counted in Spark.

Every whole text is cut into words; each window of ``window`` consecutive words has a rolling hash.
Equal windows are found by their hashes' counts; a window is *late* in a document if its word
sequence also starts in a document with a smaller id.  Late windows merge into maximal intervals
of words, and those words are removed.  Windows are judged on the input.

Scale: see ``repeats``.  Windows whose anchor occurs in one document only are never shuffled; equal
pieces collapse before their windows are exploded; hot windows are combined map-side.

Edge cases: a null or empty text has no words (nothing removed, kept text empty); rows without an id
are left out; rows sharing an id are judged apart (an equal id is not smaller); an empty table gives
an empty result; other columns are ignored (``deduplicate`` keeps them).
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

WINDOW = 50


def _units(buf, start, end):
    ws, we, row = c.words(buf, start, end)
    return c.word_hashes(buf, ws, we), row, (ws, we)


def _gram(window: int) -> int:
    return max(1, window // 4)


def _windows(window: int):
    def payload(_buf, _where, unit, begin, run):
        values = c.rolling(unit, window)[repeats.ranges(begin, run)]
        off = np.cumsum(run) - run
        inside = np.arange(len(values), dtype=np.uint64) - np.repeat(off, run).astype(np.uint64)
        content = np.add.reduceat(c.mix(values + inside * np.uint64(0x9E3779B97F4A7C15)), off) if len(run) else values
        return values, run, content
    return payload


def late_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, tid, starts``: word positions of the windows that also start in an earlier document."""
    k = _gram(window)
    texts = repeats.keyed(docs)
    shared = repeats.shared_anchors(texts, _units, k, window, twice=False, name="substring")
    found = repeats.pieces(texts, shared, _units, k, window, _windows(window), "substring")

    # equal pieces collapse: one row with the smallest document
    piece = c.stored(found.groupBy("anchor", "content").agg(
        F.min("doc_id").alias("lo"), F.count(F.lit(1)).alias("n"), F.first("payload").alias("payload")),
        "substring-distinct")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                buf, start, end = c.flat(c.column(part, "payload"))
                run = (end - start) // 8
                values = buf[int(start[0]):int(end[-1])].view(np.int64) if len(run) else np.zeros(0, np.int64)
                at = pa.array(np.repeat(np.arange(len(run)), run))
                inside = np.arange(len(values)) - np.repeat(np.cumsum(run) - run, run)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values), *[c.column(part, x).take(at) for x in ("anchor", "content", "lo", "n")],
                     pa.array(inside.astype(np.int32))], ["hash", "anchor", "content", "lo", "n", "i"])

    hashed = c.stored(c.mapped(piece, explode, "hash long, anchor long, content long, lo long, n long, i int"),
                      "substring-windows")
    counted = c.stored(hashed.groupBy("hash").agg(F.min("lo").alias("first"), F.sum("n").alias("n")).where("n > 1"),
                       "substring-counts")
    firsts = (hashed.select("hash", "anchor", "content", "i").join(counted.select("hash", "first").hint("merge"), "hash")
              .groupBy("anchor", "content").agg(F.collect_list(F.struct("i", "first")).alias("firsts")))
    firsts = c.stored(firsts, "substring-firsts")
    late = found.select("anchor", "content", "doc_id", "tid", "pos").join(firsts.hint("merge"), ["anchor", "content"])
    late = late.select("doc_id", "tid", F.expr(
        "transform(filter(firsts, x -> x.first < doc_id), x -> pos + x.i)").alias("starts")).where("size(starts) > 0")
    # repeated rows (same id and text) give the same starts: a set, combined map-side, holds them once
    return late.groupBy("doc_id", "tid").agg(F.array_sort(F.flatten(F.collect_set("starts"))).alias("starts"))


def _kept(buf, ws, we, row, n_rows, begins: list, window: int):
    """Per row the mask of removed words."""
    count = np.bincount(row, minlength=n_rows).astype(np.int64)
    first = np.cumsum(count) - count
    gone = np.zeros(len(ws) + 1, np.int32)
    for i, starts in enumerate(begins):
        if starts is not None and len(starts):
            a, b = c.merge_spans(np.asarray(starts, np.int64), window)
            gone[first[i] + a] += 1
            gone[first[i] + np.minimum(b, count[i])] -= 1
    return count, first, np.cumsum(gone[:-1]) > 0


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256``."""
    spans = late_windows(docs, window)
    joined = repeats.keyed(docs).join(spans, ["doc_id", "tid"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, done = c.column(batch, "starts"), 0
            for ids, buf, start, end in c.text_slices(iter([batch])):
                ws, we, row = c.words(buf, start, end)
                begins = starts.slice(done, len(ids)).to_pylist()
                count, first, gone = _kept(buf, ws, we, row, len(ids), begins, window)
                # words joined by one space: byte ranges of the kept words, each followed by a space
                keep = ~gone
                size = (we - ws + 1)[keep]
                at = repeats.ranges(ws[keep], size)
                joined_ = np.append(buf, np.uint8(32))[np.minimum(at, len(buf))]
                joined_[np.cumsum(size) - 1] = 32
                total = np.bincount(row[keep], weights=size, minlength=len(ids)).astype(np.int64)
                stop = np.cumsum(total)
                raw = joined_.tobytes()
                sha = [hashlib.sha256(raw[b - t:max(b - 1, b - t)]).hexdigest()
                       for b, t in zip(stop.tolist(), total.tolist(), strict=True)]
                removed = np.bincount(row[gone], minlength=len(ids)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(count), pa.array(removed), pa.array(sha)],
                                                 ["doc_id", "n_words", "n_removed", "kept_sha256"])
                done += len(ids)

    return c.stored(c.mapped(joined, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string"), "substring-digest")


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with late windows cut out of ``text``; all columns stay, documents without a late
    window keep their text byte for byte, ``n_chars`` (if there is one) is recounted where text was cut."""
    spans = late_windows(docs, window).toDF("__llm_id", "__llm_tid", "__llm_starts")
    own = docs.withColumn("__llm_key", F.xxhash64(F.col("text").cast("string")))
    joined = own.join(spans, (F.col("doc_id").cast("long") == F.col("__llm_id"))
                      & (F.col("__llm_key") == F.col("__llm_tid")), "left")

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, starts in c.relaxed(batches):
            buf, start, end = c.flat(text)
            off = np.flatnonzero(text.is_valid().to_numpy(zero_copy_only=False))
            out = [None] * len(text)
            for i in off.tolist():  # the rows that are cut
                raw = buf[start[i]:end[i]]
                ws, _we, row = c.words(raw, np.array([0]), np.array([len(raw)]))
                _, _, gone = _kept(raw, ws, None, row, 1, [starts[i].as_py()], window)
                # a removed word goes with the white space behind it
                step = np.zeros(len(raw) + 1, np.int8)
                step[ws] = np.diff(gone.astype(np.int8), prepend=np.int8(0))
                out[i] = raw[np.cumsum(step[:-1]) == 0].tobytes().decode()
            yield pa.array(out, pa.string())

    # rows without a late window send no text to Python and keep theirs
    hit = F.col("__llm_starts").isNotNull() & F.col("text").isNotNull()
    out = joined.withColumn("text", F.when(hit, cut(F.when(hit, F.col("text").cast("string")), "__llm_starts")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)

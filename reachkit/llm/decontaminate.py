"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every benchmark item is cut into windows of ``window`` consecutive words (a shorter item is one
window).  A window can only occur in a document that holds the window's rarest shingle, so:

1. document words are normalised once and written (``doc_id, n_words, words``);
2. *order*: the shingles (word pairs; single words for one-word items) that the benchmark holds are
   counted over all documents;
3. *prefix*: containment asks for all of a window's shingles, so one necessary shingle is enough:
   the rarest (by count, then text);
4. *join*: documents' shingles meet the prefix shingles; the shingle's place in the window gives the
   only possible start, which the positional and length bounds must allow;
5. *verify*: the words from that start are compared with the whole window.

Scale: the documents are never shuffled while the window table is proven small (its bytes are
counted; up to ``broadcast_bytes`` it is broadcast).  Beyond that the same join runs as a shuffle
join on the shingle, where AQE splits hot shingles.  Only verified hits are shuffled.

Edge cases: null or wordless texts and items have no words: such documents get zeros and false, such
items have no window.  Rows without a doc_id or item_id are left out.  Rows that share a doc_id are
told apart by a hash of their text; rows sharing an item_id form one item.  Empty tables: no rows, or
no hits.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachkit.llm import common as c

WINDOW = 13
BROADCAST_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """A-Z lower-cased, then the runs of characters outside the separator ranges."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, win, shingles``: the distinct windows of every item, with their shingles in order.
    A one-word window has the word itself as its shingle."""
    words = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"),
                                                      _words(F.col("text").cast("string")).alias("ws"))
    words = words.where("size(ws) > 0")
    starts = f"sequence(1, greatest(1, size(ws) - {window - 1}))"
    wins = words.select("item_id", F.explode(F.expr(f"transform({starts}, i -> slice(ws, i, {window}))")).alias("win"))
    return wins.distinct().withColumn("shingles", F.expr(
        "if(size(win) = 1, win, transform(sequence(1, size(win) - 1), i -> concat_ws(' ', get(win, i - 1), get(win, i))))"))


def _document_words(docs: DataFrame) -> DataFrame:
    base = c.documents(docs).where("doc_id is not null")
    return base.select("doc_id", F.xxhash64("text").alias("tid"), _words(F.col("text")).alias("ws")).select(
        "doc_id", "tid", F.size("ws").cast("long").alias("n_words"), "ws")


def _shingle_rows(words: DataFrame, singles: bool) -> DataFrame:
    """One row per document shingle: ``at`` (1-based) and ``shingle``."""
    exploded = words.select("*", F.posexplode("ws").alias("p", "word")).withColumn("at", F.col("p") + 1)
    if singles:
        return exploded.withColumn("shingle", F.col("word"))
    return exploded.where("at < n_words").withColumn(
        "shingle", F.concat_ws(" ", F.col("word"), F.get("ws", F.col("at"))))


def hits(words: DataFrame, items: DataFrame, window: int = WINDOW,
         broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Verified occurrences ``doc_id, tid, start, len, item_id`` of item windows in documents."""
    wins = c.stored(item_windows(items, window), "decontam-windows")
    held = wins.agg(F.coalesce(F.sum(F.expr("3 * length(array_join(win, ' ')) + 200")), F.lit(0)).alias("b"),
                    F.coalesce(F.sum(F.when(F.size("win") == 1, 1).otherwise(0)), F.lit(0)).alias("s")).first()
    small, any_single = held["b"] <= broadcast_bytes, held["s"] > 0

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df.hint("merge")

    found = None
    for single in (False, True) if any_single else (False,):
        mine = wins.where(F.size("win") == 1 if single else F.size("win") > 1)
        alone = mine.select(F.explode("shingles").alias("shingle")).distinct()
        rows = _shingle_rows(words, single)
        # rarity over all documents, of the benchmark's shingles only
        counts = rows.select("shingle").join(side(alone), "shingle", "left_semi").groupBy("shingle").count()
        counts = c.stored(counts, "decontam-counts")
        ranked = (mine.select("item_id", "win", F.posexplode("shingles").alias("off", "shingle"))
                  .join(side(counts), "shingle", "left")
                  .groupBy("item_id", "win")
                  .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "shingle", "off")).alias("rare")))
        # a window whose rarest shingle is in no document cannot occur
        prefix = c.stored(ranked.where("rare.n > 0").select(
            "item_id", "win", F.size("win").alias("len"), F.col("rare.shingle").alias("shingle"),
            F.col("rare.off").alias("off")), "decontam-prefix")
        if small:
            cand = rows.join(F.broadcast(prefix), "shingle")
        else:
            keyed = rows.select("doc_id", "tid", "at", "shingle").join(prefix.hint("merge"), "shingle")
            cand = keyed.join(words, ["doc_id", "tid"])
        cand = cand.withColumn("start", F.col("at") - F.col("off"))
        fits = (F.col("start") >= 1) & (F.col("start") + F.col("len") - 1 <= F.col("n_words"))
        same = F.expr("slice(ws, start, len) = win")
        found_ = cand.where(fits).where(same).select("doc_id", "tid", "start", "len", "item_id").distinct()
        found = found_ if found is None else found.unionByName(found_)
    return c.stored(found, "decontam-hits")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20,
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: ``doc_id, tid, n_words, n_hit, n_items, items_sha256, contaminated``."""
    words = c.stored(_document_words(docs), "decontam-words")
    found = hits(words, items, window, broadcast_bytes)
    # words inside any occurrence: the starts of a document are at most its words, so they fit a row;
    # each start covers its words up to the next start
    starts = found.groupBy("doc_id", "tid", "start").agg(F.max("len").alias("len"))
    per = starts.groupBy("doc_id", "tid").agg(F.array_sort(F.collect_list(F.struct("start", "len"))).alias("ss"))
    covered = """aggregate(ss, named_struct('n', 0L, 'upto', 1),
        (a, s) -> named_struct('n', a.n + greatest(0, s.start + s.len - greatest(a.upto, s.start)),
                               'upto', greatest(a.upto, s.start + s.len)),
        a -> a.n)"""
    spans = per.select("doc_id", "tid", F.expr(covered).alias("n_hit"))
    ids = (found.select("doc_id", "tid", F.col("item_id").cast("string").alias("item")).distinct()
           .groupBy("doc_id", "tid").agg(F.array_sort(F.collect_list("item")).alias("items")))
    both = spans.join(ids, ["doc_id", "tid"])
    out = words.select("doc_id", "tid", "n_words").join(both, ["doc_id", "tid"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "tid", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"),
                      ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def digest(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    return contamination(docs, items, window).drop("tid")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = (contamination(docs, items, window).where("contaminated")
           .select(F.col("doc_id").alias("__llm_id"), F.col("tid").alias("__llm_tid")).distinct())
    own = docs.withColumn("__llm_key", F.xxhash64(F.col("text").cast("string")))
    return own.join(bad, (F.col("doc_id").cast("long") == F.col("__llm_id")) & (F.col("__llm_key") == F.col("__llm_tid")),
                    "left_anti").select(*docs.columns)

"""Log-bilinear language model, trained by noise-contrastive estimation.

Symbols: the ``HEAD`` most frequent training words, the end of a text, and ``CLASSES`` classes of all
other words (by their last two bytes).  The model predicts a symbol from the two before it: the
context's vectors, each through a matrix of its own, are summed to a predicted vector; a symbol's score
is its product with the symbol's output vector plus a bias.  A word of a class has the class's
probability times its add-one share of the class, one share being kept for unseen words.

* counts of all training words come from Spark (any number of distinct words);
* a short start on a bounded sample of documents fixes the vectors' basis on the driver; then every
  task trains on all training tokens of its part of the corpus, and Spark averages the parameters,
  weighted by tokens;
* the sums that normalise are one matrix product over all contexts, so each token's probability is
  normalised exactly and costs three look-ups.

Counts of frequent words (``LOOKUP`` at most) go to the tasks; the other words of a text are met with
the counts table by a join, so nothing that grows with the vocabulary is broadcast.  Words are known
by 64-bit hashes.

Edge cases: a null or empty text is its end alone; rows without a doc_id are left out; rows sharing an
id are scored apart; without training rows all counts are 0, the base score is 0 and the model is
uniform over the symbols; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachkit.llm import common as c
from reachkit.llm.common import U64

HEAD, CLASSES = 511, 512
SYMBOLS = HEAD + 1 + CLASSES
END = HEAD
DIM = 24
NOISE = 96  # noise symbols per batch, shared by its tokens
BATCH = 32_768
START_DOCS, START_EPOCHS = 800, 6
RATE_START, RATE = 0.02, 0.004
LOOKUP = 1 << 16
SEED = 5
_CLASS = (c.mix(np.arange(65536, dtype=U64) + U64(SEED)) % U64(CLASSES)).astype(np.int64)


def _classes(buf, ws, we) -> np.ndarray:
    """Class of every word: a fixed function of its last two bytes."""
    last = buf[we - 1].astype(np.int64)
    return _CLASS[last * 256 + np.where(we - ws > 1, buf[np.maximum(we - 2, 0)], 0)]


# ---------------------------------------------------------------- counts

def count_words(docs: DataFrame) -> DataFrame:
    """``h, cls, n`` of all words of the training documents, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ids, buf, start, end in c.text_slices(batches):
            low = c.LOWER[buf]
            ws, we, _ = c.words(low, start, end)
            value, first, n = np.unique(c.word_hashes(low, ws, we), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(_classes(low, ws[first], we[first]).astype(np.int32)),
                 pa.array(n.astype(np.int64))], ["h", "cls", "n"])

    train = docs.where(c.fold(F.col("doc_id"), 7) != 2)
    return c.stored(c.mapped(train, run, "h long, cls int, n long").groupBy("h")
                    .agg(F.min("cls").alias("cls"), F.sum("n").alias("n")), "lm-counts")


@dataclass
class Vocabulary:
    """What the tasks need of the counts; all bounded by parameters."""

    hashes: np.ndarray  # the LOOKUP most frequent words, sorted by hash
    counts: np.ndarray
    symbol: np.ndarray  # their symbol, -1: its class
    sums: np.ndarray  # per class: counts plus one of its words, plus one for unseen words
    tokens: int  # N
    types: int  # V
    ends: int
    unigram: np.ndarray  # symbols' shares of the training tokens

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, known) among the frequent words."""
        if len(self.hashes) == 0:
            return np.zeros(len(value), np.int64), np.zeros(len(value), bool)
        place = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
        return place, self.hashes[place] == value

    def symbols(self, buf, start, end):
        """Symbols of all rows in order, ends included; row of each; and per word: its index in the
        symbols, hash, place and whether it is among the frequent words."""
        low = c.LOWER[buf]
        ws, we, row = c.words(low, start, end)
        value = c.word_hashes(low, ws, we)
        place, known = self.find(value)
        sym = HEAD + 1 + _classes(low, ws, we)
        if len(self.hashes):
            own = np.where(known, self.symbol[place], -1)
            sym = np.where(own >= 0, own, sym)
        n = np.bincount(row, minlength=len(start)) + 1
        at = np.arange(len(ws)) + row  # one end per row before
        out = np.full(int(n.sum()), END, np.int64)
        out[at] = sym
        return out, np.repeat(np.arange(len(start)), n), (at, value, place, known)


def vocabulary(counts: DataFrame, n_docs: int) -> Vocabulary:
    sums = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    top = counts.orderBy(F.desc("n"), "h").limit(LOOKUP).collect()  # bounded by LOOKUP
    head = [r["h"] for r in top[:HEAD]]
    by_class = {r["cls"]: (r["n"], r["v"]) for r in counts.groupBy("cls").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}  # at most CLASSES rows
    total, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, (n, v) in by_class.items():
        total[k], types[k] = n, v
    for r in top[:HEAD]:
        total[r["cls"]] -= r["n"]
        types[r["cls"]] -= 1
    hashes = np.array([r["h"] for r in top], np.int64).view(U64)
    order = np.argsort(hashes)
    place = {h: i for i, h in enumerate(head)}
    symbol = np.array([place.get(r["h"], -1) for r in top], np.int64)
    n_tokens = int(sums["n"]) + n_docs
    unigram = np.concatenate([np.array([r["n"] for r in top[:HEAD]] + [0] * (HEAD - len(head)), float), [n_docs], total]) + 1
    return Vocabulary(hashes[order], np.array([r["n"] for r in top], np.int64)[order], symbol[order],
                      total + types + 1, n_tokens, int(sums["v"]) + (1 if n_docs else 0), n_docs, unigram / unigram.sum())


# ---------------------------------------------------------------- the network

@dataclass
class LogBilinear:
    """``context``: vectors of the context symbols, ``maps``: a matrix per context position (1 and 2
    back), ``output`` and ``bias``: of the predicted symbol."""

    context: np.ndarray
    maps: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray) -> LogBilinear:
        rng = np.random.default_rng(SEED)
        n = len(unigram)
        return cls(rng.normal(0, 0.1, (n, DIM)).astype(np.float32),
                   (np.eye(DIM) * np.array([0.7, 0.5])[:, None, None]).astype(np.float32),
                   rng.normal(0, 0.1, (n, DIM)).astype(np.float32), np.log(unigram).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.maps, self.output, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in self.parts()])

    def from_flat(self, flat: np.ndarray) -> LogBilinear:
        out, at = [], 0
        for x in self.parts():
            out.append(flat[at:at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return LogBilinear(*out)

    def nce(self, c1, c2, w, noise, log_kq):
        """Gradients of the noise-contrastive loss of a batch.  ``noise``: symbols shared by the batch,
        ``log_kq``: log of noise count times noise probability, for every symbol."""
        v1, v2 = self.context[c1], self.context[c2]
        predicted = v1 @ self.maps[0] + v2 @ self.maps[1]
        target = self.output[w]
        true = 1 / (1 + np.exp(-np.clip(np.einsum("bd,bd->b", predicted, target) + self.bias[w] - log_kq[w], -30, 30)))
        out_n = self.output[noise]
        delta = predicted @ out_n.T
        delta += self.bias[noise] - log_kq[noise]
        np.clip(delta, -30, 30, out=delta)
        np.exp(-delta, out=delta)
        delta += 1
        np.reciprocal(delta, out=delta)  # probability of "data" for the noise
        up = true - 1
        g_pred = up[:, None] * target + delta @ out_n
        n = len(self.bias)
        g_out = _scatter(w, up[:, None] * predicted, n)
        np.add.at(g_out, noise, delta.T @ predicted)
        g_bias = np.bincount(w, weights=up, minlength=n) + np.bincount(noise, weights=delta.sum(0), minlength=n)
        g_maps = np.stack([v1.T @ g_pred, v2.T @ g_pred])
        g_context = _scatter(c1, g_pred @ self.maps[0].T, n) + _scatter(c2, g_pred @ self.maps[1].T, n)
        return [g / len(w) for g in (g_context, g_maps, g_out, g_bias)]

    def tables(self):
        """(scores of the symbol one back, two back with bias, log of the normalising sum of every
        context): the sums of all contexts are one matrix product."""
        one = (self.context @ self.maps[0] @ self.output.T).astype(np.float64)
        two = (self.context @ self.maps[1] @ self.output.T).astype(np.float64) + self.bias
        m1, m2 = one.max(1), two.max(1)
        z = np.exp(one - m1[:, None]) @ np.exp(two - m2[:, None]).T
        return one.astype(np.float32), two.astype(np.float32), (np.log(np.maximum(z, 1e-300)) + m1[:, None] + m2).astype(np.float32)


def _scatter(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of rows by index."""
    return np.stack([np.bincount(index, weights=rows[:, j], minlength=n) for j in range(rows.shape[1])], 1)


class Trainer:
    """Adam over batches of (one back, two back, symbol)."""

    def __init__(self, model: LogBilinear, unigram: np.ndarray, rate: float, seed: int):
        self.model, self.rate, self.rng, self.steps = model, rate, np.random.default_rng(seed), 0
        self.edges = np.cumsum(unigram)
        self.log_kq = np.log(NOISE * unigram).astype(np.float32)
        self.m = [np.zeros_like(x) for x in model.parts()]
        self.v = [np.zeros_like(x) for x in model.parts()]

    def step(self, c1, c2, w) -> None:
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), len(self.edges) - 1)
        self.steps += 1
        t = self.steps
        for x, g, m, v in zip(self.model.parts(), self.model.nce(c1, c2, w, noise, self.log_kq), self.m, self.v, strict=True):
            g = g.astype(np.float32)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-6)


def contexts(sym: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols one and two back inside the row; before a row's start: the end symbol."""
    one, two = np.full(len(sym), END), np.full(len(sym), END)
    if len(sym) > 1:
        one[1:] = np.where(row[1:] == row[:-1], sym[:-1], END)
    if len(sym) > 2:
        two[2:] = np.where(row[2:] == row[:-2], sym[:-2], END)
    return one, two


def _start(train_docs: DataFrame, vocab: Vocabulary, n_docs: int) -> LogBilinear:
    """Parameters after a few epochs over a bounded sample of documents, on the driver."""
    model = LogBilinear.start(vocab.unigram)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, START_DOCS / max(1, n_docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ids, buf, start, end in c.text_slices(batches):
            sym, row, _ = vocab.symbols(buf, start, end)
            yield pa.RecordBatch.from_arrays([c.packed(sym.astype("<u2"), np.bincount(row, minlength=len(start)))], ["s"])

    rows = sorted(bytes(r["s"]) for r in train_docs.where(share).limit(2 * START_DOCS).mapInArrow(run, "s binary").collect())
    if not rows:
        return model
    sym = np.frombuffer(b"".join(rows), "<u2").astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) // 2 for r in rows])
    one, two = contexts(sym, row)
    trainer = Trainer(model, vocab.unigram, RATE_START, SEED)
    size = min(BATCH // 4, max(256, len(sym) // 8))
    for epoch in range(START_EPOCHS):
        order = np.random.default_rng(SEED + epoch).permutation(len(sym))
        trainer.rate = RATE_START * (1 - epoch / START_EPOCHS)
        for i in range(0, len(order), size):
            part = order[i:i + size]
            trainer.step(one[part], two[part], sym[part])
    return trainer.model


def train(docs: DataFrame, vocab: Vocabulary, n_docs: int) -> LogBilinear:
    """Every task trains on all training tokens of its part; Spark averages, weighted by tokens."""
    train_docs = docs.where(c.fold(F.col("doc_id"), 7) != 2)
    base = _start(train_docs, vocab, n_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng(SEED)
        trainer, tokens = Trainer(base.from_flat(base.flat()), vocab.unigram, RATE, SEED + TaskContext.get().partitionId()), 0
        for _ids, buf, start, end in c.text_slices(batches):
            sym, row, _ = vocab.symbols(buf, start, end)
            one, two = contexts(sym, row)
            order = rng.permutation(len(sym))
            for i in range(0, len(order), BATCH):
                part = order[i:i + BATCH]
                trainer.step(one[part], two[part], sym[part])
            tokens += len(sym)
        if tokens:
            flat = trainer.model.flat().astype(np.float64) * tokens
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat) + 1, dtype=np.int32)), pa.array(np.append(flat, float(tokens)))], ["at", "value"])

    rows = (c.mapped(train_docs, run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
            .collect())  # one row per parameter
    if not rows:
        return base
    flat = np.zeros(len(rows))
    for r in rows:
        flat[r["at"]] = r["value"]
    return base.from_flat(flat[:-1] / flat[-1])


# ---------------------------------------------------------------- scoring

PARTIAL = ("row long, doc_id long, n_tokens long, n_known long, log_counts double, model double, "
           "hashes array<long>, times array<int>")


def score(docs: DataFrame, vocab: Vocabulary, model: LogBilinear, counts: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocab, *model.tables()))  # bounded by SYMBOLS squared and LOOKUP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        voc, p1, p2, log_z = shared.value
        log_n, log_sum = np.log10(voc.counts + 1.0), np.log10(voc.sums)
        next_row = TaskContext.get().partitionId() << 40
        for ids, buf, start, end in c.text_slices(batches):
            n = len(ids)
            sym, row, (at, value, place, known) = voc.symbols(buf, start, end)
            one, two = contexts(sym, row)
            log_p = (p1[one, sym].astype(np.float64) + p2[two, sym] - log_z[one, two]) / np.log(10)
            is_class = sym > END
            model_ = np.bincount(row, weights=log_p - np.where(is_class, log_sum[np.maximum(sym - HEAD - 1, 0)], 0.0), minlength=n)
            word_row = row[at]
            own = log_n[place] * known if len(log_n) else np.zeros(len(at))
            logs = np.bincount(word_row, weights=own, minlength=n) + np.log10(voc.ends + 1.0)
            model_ += np.bincount(word_row, weights=own * is_class[at], minlength=n)
            found = np.bincount(word_row, weights=known, minlength=n).astype(np.int64) + (voc.ends > 0)
            # the other words: once per document, with their number
            rare = np.flatnonzero(~known)
            order = np.lexsort((value[rare], word_row[rare]))
            r, h = word_row[rare][order], value[rare][order]
            new = np.append(True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])) if len(r) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(r))).astype(np.int32)
            per = np.bincount(r[first], minlength=n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(next_row + np.arange(n)), ids, pa.array(np.bincount(row, minlength=n).astype(np.int64)),
                 pa.array(found), pa.array(logs), pa.array(model_),
                 c.lists(pa.array(h[first].view(np.int64)), per), c.lists(pa.array(times), per)],
                [x.split()[0] for x in PARTIAL.split(", ")])
            next_row += n

    partial = c.stored(c.mapped(docs, run, PARTIAL), "lm-partial")
    rare = partial.select("row", F.explode(F.arrays_zip("hashes", "times")).alias("x")).select(
        "row", F.col("x.hashes").alias("h"), F.col("x.times").alias("k"))
    met = (rare.join(counts.select("h", "n").hint("merge"), "h")
           .groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("k").alias("k")))
    out = partial.drop("hashes", "times").join(met, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    # without training tokens nothing is known and the base is certain of "unseen"
    space = float(np.log10(vocab.tokens + vocab.types + 1.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") + more - F.col("n_tokens") * F.lit(space)).alias("base_score"),
        (F.col("model") + more).alias("score"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    texts = c.documents(docs).where("doc_id is not null")
    n_docs = texts.where(c.fold(F.col("doc_id"), 7) != 2).count()
    counts = count_words(texts)
    vocab = vocabulary(counts, n_docs)
    scored = score(texts, vocab, train(texts, vocab, n_docs), counts)
    return scored.select("doc_id", (c.fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")

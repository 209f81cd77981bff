"""Toxicity by multiple-instance learning: documents are bags of sentences.

Only documents have labels.  A sentence's score is a logistic function of the word features that it
holds; a document's probability is the noisy-or of its sentences, 1 - prod(1 - p).  The weights are
trained through the noisy-or from document labels, so the model learns which sentences offend and can
point at them (``offending_sentences``).

Features are lower-cased words (A-Z) and their first bytes, known by 64-bit hashes.  The features that
tell the classes apart are counted in Spark over a bounded sample of labelled documents (``SAMPLE``
rows, half of them of each label, the smallest hashes of doc_id and text; rows equal in both count once;
``FEATURES`` features at most); the sample's sentences, reduced to those features, are trained on the
driver.  Scoring is one map-only pass over whole texts.

Edge cases: a null, empty or wordless text has no sentence and scores 0; labels, lang, source and
doc_id are never inputs; null or repeated labels: rows with a null label or id are left out, of a
repeated id the largest label counts; without a label of both kinds every score is the share of toxic
labels (0 without labels); rows without a doc_id get a score but no fold (null); empty tables give no
row; extra columns are ignored.
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

SAMPLE = 16_000  # labelled documents used for fitting, at most
FEATURES = 4096  # features kept, at most
LEAST_SHARE = 0.1  # toxic documents weigh at least so much of the sample (if it holds as many)
LEAST_DOCS = 4  # toxic sample documents that a feature must be in
PREFIXES = (4, 5, 6)  # first bytes of a word that are features of their own
THRESHOLD = 0.3
_BREAK = np.zeros(256, bool)
_BREAK[[ord(x) for x in ".!?\n"]] = True


def _features(buf, start, end):
    """(feature hashes, one array per kind), sentence number and row of every word."""
    low = c.LOWER[buf]
    ws, we, row = c.words(low, start, end, c.NOT_ALNUM)
    kinds = [c.word_hashes(low, ws, we)]
    for i, n in enumerate(PREFIXES):
        kinds.append(c.word_hashes(low, ws, np.minimum(ws + n, we)) ^ U64(0x51ED270B27D4EB4F * (i + 1) & (1 << 64) - 1))
    stop = np.cumsum(_BREAK[buf], dtype=np.int64) if len(buf) else np.zeros(0, np.int64)
    sentence = stop[ws] + row if len(ws) else np.zeros(0, np.int64)  # grows with every break and every row
    return kinds, sentence, row


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    constant: float | None = None  # without labels of both kinds

    def __post_init__(self):
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.features & U64(0xFFFF)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into hashes, index into features) of the hashes that are features."""
        at = np.flatnonzero(self.maybe[(hashes & U64(0xFFFF)).astype(np.int64)])
        if len(at) == 0 or len(self.features) == 0:
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.features, hashes[at]), len(self.features) - 1)
        same = self.features[place] == hashes[at]
        return at[same], place[same]

    def sentences(self, buf, start, end):
        """Per sentence that holds words: row, score; per row: number of sentences."""
        kinds, sentence, row = _features(buf, start, end)
        n = len(sentence)
        new = np.ones(n, bool)
        new[1:] = sentence[1:] != sentence[:-1]
        number = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        z = np.full(len(first), self.bias)
        for hashes in kinds:
            at, place = self.find(hashes)
            z += np.bincount(number[at], weights=self.weights[place], minlength=len(first))
        return row[first], 1 / (1 + np.exp(-np.clip(z, -40, 40))), first

    def documents(self, buf, start, end):
        """(noisy-or score, number of sentences, worst sentence from 1, its score) of every row."""
        n = len(start)
        row, p, _ = self.sentences(buf, start, end)
        count = np.bincount(row, minlength=n)
        if self.constant is not None:
            return np.full(n, self.constant), count, np.zeros(n, np.int64), np.zeros(n)
        none = np.bincount(row, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)
        worst, worst_p = np.zeros(n, np.int64), np.zeros(n)
        if len(row):
            order = np.lexsort((-np.arange(len(row)), p, row))  # last of a row: largest score, first on ties
            last = np.flatnonzero(np.append(row[1:] != row[:-1], True))
            best = order[last]
            first_of_row = np.cumsum(count) - count
            worst[row[best]] = best - first_of_row[row[best]] + 1
            worst_p[row[best]] = p[best]
        return np.clip(-np.expm1(none), 0.0, 1.0), count, worst, worst_p


# ---------------------------------------------------------------- training

def _known(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic`` of the labels used for training."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .where(c.fold(F.col("doc_id"), 4) != 2))
    return known.withColumn("toxic", (F.col("toxic") > 0).cast("int"))


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """The bounded sample ``doc_id, text, toxic`` of labelled training documents (fold 2 stays out): at most
    ``sample`` / 2 of each label, different in doc_id or text."""
    known = c.stored(_known(labels), "toxicity-known")
    texts = c.documents(docs).where("doc_id is not null").withColumn("tid", F.xxhash64("text"))
    met = c.stored(texts.select("doc_id", "tid").distinct(), "toxicity-rows").join(known.hint("merge"), "doc_id")
    # spread by hash, not in the order of doc_id; at most ``sample`` small rows, so they may be broadcast
    chosen = [met.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id", "tid"), "doc_id", "tid").limit(sample // 2)
              for kind in (0, 1)]
    chosen = c.stored(chosen[0].unionByName(chosen[1]), "toxicity-sample")
    texts = texts.join(F.broadcast(chosen), ["doc_id", "tid"]).groupBy("doc_id", "tid").agg(
        F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    return c.stored(texts.select("doc_id", "text", "toxic"), "toxicity-labelled")


def _count_features(texts: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, done = c.column(batch, "toxic").to_numpy(zero_copy_only=False).astype(bool), 0
            for ids, buf, start, end in c.text_slices(iter([batch])):
                kinds, _, row = _features(buf, start, end)
                y = toxic[done:done + len(ids)]
                done += len(ids)
                h, r = np.concatenate(kinds), np.tile(row, len(kinds))
                order = np.lexsort((r, h))
                h, r = h[order], r[order]
                keep = np.ones(len(h), bool)
                keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])  # documents, not occurrences
                h, pos = h[keep], y[r[keep]]
                value, first = np.unique(h, return_index=True)
                if len(value):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(value.view(np.int64)), pa.array(np.add.reduceat(pos.astype(np.int64), first)),
                         pa.array(np.add.reduceat((~pos).astype(np.int64), first))], ["h", "pos", "neg"])

    return (c.mapped(texts, count, "h long, pos long, neg long").groupBy("h")
            .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))


def _bags(texts: DataFrame, model: Model) -> DataFrame:
    """Per sample document: its label, number of sentences, and (sentence, feature) pairs packed."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, done = c.column(batch, "toxic").to_numpy(zero_copy_only=False), 0
            for ids, buf, start, end in c.text_slices(iter([batch])):
                kinds, sentence, row = _features(buf, start, end)
                new = np.ones(len(row), bool)
                new[1:] = sentence[1:] != sentence[:-1]
                count = np.bincount(row[new], minlength=len(ids)).astype(np.int64)
                number = np.cumsum(new) - 1
                first = np.cumsum(count) - count
                pairs = [model.find(h) for h in kinds]
                at = np.concatenate([p[0] for p in pairs])
                what = np.concatenate([p[1] for p in pairs])
                order = np.argsort(row[at], kind="stable")
                at, what = at[order], what[order]
                flat = np.stack([number[at] - first[row[at]], what], 1).astype("<i4").reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(toxic[done:done + len(ids)].astype(np.int32)), pa.array(count),
                     c.packed(flat, 2 * np.bincount(row[at], minlength=len(ids)))], ["toxic", "n", "pairs"])
                done += len(ids)

    return c.mapped(texts, reduce, "toxic int, n long, pairs binary")


def fit_noisy_or(y: np.ndarray, n: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray,
                 n_features: int, steps: int = 400, rate: float = 0.1, shrink: float = 2e-4,
                 weight: np.ndarray | float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of the sentence score that maximise the documents' noisy-or likelihood
    (Adam over the whole sample).  ``n``: sentences of every document; sentences without a feature
    all score sigmoid(bias) and are only counted.  ``weight``: of every document."""
    key, inverse = np.unique(doc.astype(np.int64) << 32 | sentence, return_inverse=True)
    of = (key >> 32).astype(np.int64)
    plain = n - np.bincount(of, minlength=len(y))
    theta = np.zeros(n_features + 1)
    theta[-1] = -8.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, b = theta[:-1], theta[-1]
        z = np.clip(b + np.bincount(inverse, weights=w[feature], minlength=len(key)), -30, 30)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-np.clip(b, -30, 30)))
        none = np.bincount(of, weights=np.log1p(-p), minlength=len(y)) + plain * np.log1p(-p0)
        prob = np.maximum(-np.expm1(none), 1e-12)
        scale = weight * np.where(y > 0, -(1 - prob) / prob, 1.0)  # d loss / d z = scale * p
        gz = scale[of] * p
        g = np.append(np.bincount(feature, weights=gz[inverse], minlength=n_features),
                      gz.sum() + (scale * plain).sum() * p0) / len(y)
        g[:-1] += shrink * w / 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        # features that do not help go to zero
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - rate * shrink, 0)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    texts = _labelled(docs, labels, sample)
    kinds = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = np.zeros(0, U64)
    if len(kinds) < 2:
        share = float(kinds.get(1, 0) > 0)
        return Model(none, np.zeros(0), 0.0, share)
    odds = (F.log((F.col("pos") + 0.5) / F.lit(kinds[1] + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(kinds[0] + 1.0)))
    counted = (_count_features(texts).where(F.col("pos") >= LEAST_DOCS).withColumn("odds", odds)
               .where("odds > 1").orderBy(F.desc(F.col("odds") * F.sqrt("pos")), "h").limit(FEATURES))
    found = np.sort(np.array([r["h"] for r in counted.select("h").collect()], np.int64).view(U64))
    model = Model(found, np.zeros(len(found)), -8.0)
    bags = _bags(texts, model).collect()  # at most ``sample`` rows of the kept features
    y = np.array([r["toxic"] for r in bags])
    n = np.array([r["n"] for r in bags], np.int64)
    pairs = [np.frombuffer(r["pairs"], "<i4").reshape(-1, 2) for r in bags]
    doc = np.repeat(np.arange(len(bags)), [len(x) for x in pairs])
    flat = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int32)
    # the labels' own share of toxic ones, which the sample by label hides
    whole = {r["toxic"]: r["n"] for r in _known(labels).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    mine = kinds[1] / (kinds[0] + kinds[1])
    share = min(mine, max(whole[1] / (whole[0] + whole[1]), LEAST_SHARE))
    weight = np.where(y > 0, share / mine, (1 - share) / (1 - mine))
    weights, bias = fit_noisy_or(y, n, doc, flat[:, 0].astype(np.int64), flat[:, 1].astype(np.int64), len(found), weight=weight)
    return Model(found, weights, bias)


# ---------------------------------------------------------------- scoring

def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``doc_id, score, n_sentences, worst_sentence, worst_score`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, buf, start, end in c.text_slices(batches, key):
            p, n, worst, worst_p = model.documents(buf, start, end)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(p), pa.array(n.astype(np.int64)), pa.array(worst), pa.array(worst_p)],
                [key, "score", "n_sentences", "worst_sentence", "worst_score"])

    return c.mapped(docs, run, f"{key} long, score double, n_sentences long, worst_sentence long, worst_score double")


def digest(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, n_sentences, worst_sentence, worst_score``."""
    scored = c.stored(score(c.documents(docs), train(docs, labels)), "toxicity-scores")
    return scored.select("doc_id", (c.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"),
                         "n_sentences", "worst_sentence", "worst_score")


def offending_sentences(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``doc_id, sentence (from 1), text, score`` of the sentences that score at least ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, buf, start, end in c.text_slices(batches):
            row, p, _first = model.sentences(buf, start, end)
            ws, _, word_row = c.words(c.LOWER[buf], start, end, c.NOT_ALNUM)
            begin = ws[_first]
            stops = np.flatnonzero(_BREAK[buf]) + 1
            reach = np.append(stops, len(buf))[np.searchsorted(stops, begin, "right")]
            reach = np.minimum(reach, end[row])
            number = np.arange(len(row)) - np.searchsorted(row, row) + 1
            hit = np.flatnonzero(p >= threshold)
            raw = buf.tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row[hit])), pa.array(number[hit]),
                 pa.array([raw[a:b].decode() for a, b in zip(begin[hit], reach[hit], strict=True)], pa.string()),
                 pa.array(p[hit])], ["doc_id", "sentence", "text", "score"])

    return c.mapped(c.documents(docs), run, "doc_id long, sentence long, text string, score double")


def remove_toxic(docs: DataFrame, labels: DataFrame, model: Model | None = None,
                 threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns: one map-only pass, in which
    only the text goes to Python and only the decision comes back."""
    c.ship(docs.sparkSession)
    model = model or train(docs, labels)

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in c.relaxed(texts):
            buf, start, end = c.flat(text)
            keep = [np.zeros(0, bool)]
            for i, j in c.row_slices(start, end):
                lo, hi = int(start[i]), int(end[j - 1])
                keep.append(model.documents(buf[lo:hi], start[i:j] - lo, end[i:j] - lo)[0] < threshold)
            yield pa.array(np.concatenate(keep))

    return docs.where(clean(F.col("text").cast("string")))

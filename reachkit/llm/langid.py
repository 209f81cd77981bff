"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read a block of bytes, one from each end; every byte position gets a probability for each
language from both states.  A document's probability is the mean over all its positions.  Texts are
read whole, in blocks of ``BLOCK`` bytes (the states start anew in each block), many blocks at once.

The network is trained here in numpy by backpropagation through time, on the driver, on a bounded
sample: about ``SAMPLE`` labelled documents of each language outside fold 2, ``CUTS`` blocks from each
(spread over the whole text; a text shorter than a block is one, masked behind its end).  Rows are drawn by
a hash of id and text, equal rows once, and all languages are learned.  Prediction is one map-only pass.

Edge cases: ``und`` with score 0 for a null text, a text without a letter, or if nothing could be
learned; ties go to the language that sorts first; rows with a null lang are not learned from; rows
without a doc_id get a prediction but no fold (null); an empty table gives no row; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachkit.llm import common as c

SAMPLE = 400  # documents per language, about
CUTS = 4
TRAIN_BLOCK = 48
BLOCK = 128
HIDDEN, EMBED = 8, 6
STEPS, BATCH, RATE = 400, 256, 0.02
SEED = 11
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


@dataclass
class Network:
    """Parameters, stacked for the two directions.  ``w`` maps [state, embedded byte, 1] to the update
    gate, the reset gate, and the candidate's input and state parts."""

    langs: list[str]
    embed: np.ndarray  # 2 x EMBED x 256
    w: np.ndarray  # 2 x 4 HIDDEN x (HIDDEN + EMBED + 1)
    out: np.ndarray  # languages x (2 HIDDEN + 1)

    @classmethod
    def start(cls, langs: list[str], rng) -> Network:
        h, e = HIDDEN, EMBED
        w = rng.normal(0, 1 / np.sqrt(h + e), (2, 4 * h, h + e + 1))
        w[:, 2 * h:3 * h, :h] = 0
        w[:, 3 * h:, h:] = 0
        w[:, :, -1] = 0
        return cls(langs, rng.normal(0, 1, (2, e, 256)).astype(np.float32), w.astype(np.float32),
                   rng.normal(0, 0.3, (len(langs), 2 * h + 1)).astype(np.float32))

    def states(self, x: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """States of both directions at every position: 2 x T x HIDDEN x B.  ``x``: T x B bytes,
        ``mask``: T x B, 0 behind the end of a block (None: no block is short)."""
        t_n, b = x.shape
        h = HIDDEN
        states = np.empty((2, t_n, h, b), np.float32)
        tape = []
        for d in range(2):
            s = np.ones((h + EMBED + 1, b), np.float32)
            s[:h] = 0
            pre = np.empty((4 * h, b), np.float32)
            gates, new = pre[:2 * h], np.empty((h, b), np.float32)
            # sigmoid(a) = (1 + tanh(a / 2)) / 2: the halving is put into the weights
            w = self.w[d].copy()
            w[:2 * h] *= 0.5
            for t in range(t_n) if d == 0 else range(t_n - 1, -1, -1):
                np.take(self.embed[d], x[t], axis=1, out=s[h:h + EMBED], mode="clip")
                np.matmul(w, s, out=pre)
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                z, r = gates[:h], gates[h:]
                np.multiply(r, pre[3 * h:], out=new)
                new += pre[2 * h:3 * h]
                np.tanh(new, out=new)
                if keep:
                    tape.append((d, t, s.copy(), pre.copy(), new.copy()))
                state = s[:h]
                state -= new
                state *= z
                state += new
                if mask is not None:
                    state *= mask[t]
                states[d, t] = state
        return (states, tape) if keep else states

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """Languages x T x B: the label of every position."""
        h = HIDDEN
        _, t_n, _, b = states.shape
        flat = [np.ascontiguousarray(states[d].transpose(1, 0, 2)).reshape(h, t_n * b) for d in range(2)]
        p = self.out[:, :h] @ flat[0]
        p += self.out[:, h:2 * h] @ flat[1]
        p += self.out[:, -1:]
        p -= p.max(0)
        np.exp(p, out=p)
        p /= p.sum(0)
        return p.reshape(-1, t_n, b)

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray | None = None):
        """(loss, gradients of embed, w, out) of the positions' cross entropy (those behind a block's end
        are masked)."""
        h, (t_n, b) = HIDDEN, x.shape
        states, tape = self.states(x, mask, keep=True)
        p = self.probabilities(states)
        at = (y[None, :], np.arange(t_n)[:, None], np.arange(b)[None, :])
        kept = np.ones((t_n, b), np.float32) if mask is None else mask
        loss = -(np.log(np.maximum(p[at], 1e-9)) * kept).sum() / kept.sum()
        p[at] -= 1
        p *= kept / kept.sum()
        both = np.concatenate([states[0], states[1], np.ones((t_n, 1, b), np.float32)], 1)  # T x (2H+1) x B
        g_out = np.einsum("ltb,tfb->lf", p, both)
        back = np.einsum("lf,ltb->tfb", self.out[:, :2 * h], p)
        g_w, g_e, carry = np.zeros_like(self.w), np.zeros_like(self.embed), None
        at_, parts = [[], []], [[], []]
        for d, t, s, pre, new in reversed(tape):
            if carry is None or carry[0] != d:
                carry = (d, np.zeros((h, b), np.float32))
            dh = (carry[1] + back[t, d * h:(d + 1) * h]) * kept[t]
            z, r, hn, prev = pre[:h], pre[h:2 * h], pre[3 * h:], s[:h]
            dn = dh * (1 - z) * (1 - new * new)
            dr = dn * hn
            dpre = np.concatenate([dh * (prev - new) * z * (1 - z), dr * r * (1 - r), dn, dn * r])
            g_w[d] += dpre @ s.T
            ds = self.w[d].T @ dpre
            carry = (d, dh * z + ds[:h])
            at_[d].append(x[t])
            parts[d].append(ds[h:h + EMBED])
        for d in range(2):
            where, value = np.concatenate(at_[d]), np.concatenate(parts[d], 1)
            for j in range(EMBED):
                g_e[d, j] = np.bincount(where, weights=value[j], minlength=256)
        g_w[:, 2 * h:3 * h, :h] = 0
        g_w[:, 3 * h:, h:] = 0
        return loss, [g_e, g_w, g_out]


def fit(blocks: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = STEPS, size: np.ndarray | None = None) -> Network:
    """Backpropagation through time with Adam over random batches of blocks (N x TRAIN_BLOCK bytes, of which
    ``size`` are text)."""
    rng = np.random.default_rng(SEED)
    net = Network.start(langs, rng)
    theta = [net.embed, net.w, net.out]
    m, v = [np.zeros_like(a) for a in theta], [np.zeros_like(a) for a in theta]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(blocks), BATCH)
        short = size is not None and (size[pick] < blocks.shape[1]).any()
        mask = (np.arange(blocks.shape[1])[:, None] < size[pick][None, :]).astype(np.float32) if short else None
        _, grads = net.gradients(np.ascontiguousarray(blocks[pick].T), labels[pick], mask)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2.0 - 2.0 * step / (steps + 1))
        for a, g, mi, vi in zip(theta, grads, m, v, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            mi += 0.1 * (g - mi)
            vi += 0.01 * (g * g - vi)
            a -= (rate * (mi / (1 - 0.9 ** step)) / (np.sqrt(vi / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return net


def train(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang"))
    known = known.where("doc_id is not null and lang is not null").where(c.fold(F.col("doc_id"), 4) != 2)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not counts:
        return None
    langs = sorted(counts)
    # about ``sample`` rows per language by a hash of id and text; equal rows once
    part = F.create_map(*[F.lit(x) for l in langs for x in (l, int((1 << 40) * min(1.0, sample / counts[l])))])
    drawn = F.xxhash64("doc_id", "text")
    chosen = (known.withColumn("h", drawn).where(F.pmod("h", F.lit(1 << 40)) < part[F.col("lang")])
              .dropDuplicates(["lang", "h"]).orderBy("h", "lang").limit(2 * sample * len(langs)).select("lang", "text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = c.column(batch, "lang")
            buf, start, end = c.flat(c.column(batch, "text"))
            blocks, at = [], []
            for i, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
                # spread over the whole text; a shorter text is one block, masked behind its end
                for k in range(CUTS if b - a >= TRAIN_BLOCK else min(1, b - a)):
                    lo = a + max(0, b - a - TRAIN_BLOCK) * k // max(1, CUTS - 1)
                    blocks.append(buf[lo:min(b, lo + TRAIN_BLOCK)].tobytes())
                    at.append(i)
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(at, pa.int64())), pa.array(blocks, pa.binary())],
                                             ["lang", "block"])

    rows = c.mapped(chosen, cut, "lang string, block binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["block"])))  # the same batches whatever the order of rows
    size = np.array([len(r["block"]) for r in rows])
    blocks = np.frombuffer(b"".join(bytes(r["block"]).ljust(TRAIN_BLOCK, b"\0") for r in rows), np.uint8).reshape(-1, TRAIN_BLOCK)
    found = sorted({r["lang"] for r in rows})
    labels = np.array([found.index(r["lang"]) for r in rows])
    return fit(blocks, labels, found, size=size)


def _pooled(net: Network, buf: np.ndarray, start: np.ndarray, end: np.ndarray, at_once: int = 2048) -> np.ndarray:
    """Rows x languages: mean of the positions' probabilities."""
    n = -(-(end - start) // BLOCK)
    row = np.repeat(np.arange(len(start)), n)
    first = np.repeat(start, n) + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * BLOCK
    size = np.minimum(BLOCK, end[row] - first)
    order = np.argsort(size, kind="stable")  # short blocks together: only their batches need masks
    total = np.zeros((len(start), len(net.langs)))
    reach = np.arange(BLOCK)
    for i in range(0, len(order), at_once):
        part = order[i:i + at_once]
        t_n = int(size[part].max())
        short = int(size[part].min()) < t_n
        x = buf[np.minimum(first[part][None, :] + reach[:t_n, None], max(len(buf) - 1, 0))]
        mask = (reach[:t_n, None] < size[part][None, :]).astype(np.float32) if short else None
        p = net.probabilities(net.states(x, mask))
        if mask is not None:
            p *= mask
        sums = p.sum(1)
        for k in range(len(net.langs)):
            total[:, k] += np.bincount(row[part], weights=sums[k], minlength=len(start))
    return total / np.maximum(end - start, 1)[:, None]


def _letters(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows that hold a letter of any script."""
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[buf])])
    has = seen[end] > seen[start]
    for i in np.flatnonzero(~has & (end > start)):
        has[i] = any(ch.isalpha() for ch in buf[start[i]:end[i]].tobytes().decode())
    return has


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, lang_pred, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, buf, start, end in c.text_slices(batches):
            lang, score = np.full(len(ids), "und", object), np.zeros(len(ids))
            if net is not None:
                has = np.flatnonzero(_letters(buf, start, end))
                if len(has):
                    p = _pooled(net, buf, start[has], end[has])
                    best = p.argmax(1)
                    lang[has] = np.array(net.langs, object)[best]
                    score[has] = np.clip(p[np.arange(len(has)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(score)],
                                             ["doc_id", "lang_pred", "score"])

    return c.stored(c.mapped(c.documents(docs), run, "doc_id long, lang_pred string, score double"), "langid-scores")


def position_labels(net: Network, text: bytes) -> np.ndarray:
    """Language number of every byte position of one text, in blocks as ``predict`` reads it."""
    out = []
    for i in range(0, len(text), BLOCK):
        x = np.frombuffer(text[i:i + BLOCK], np.uint8)[:, None]
        out.append(net.probabilities(net.states(x, None))[:, :, 0].argmax(0))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``."""
    c.ship(docs.sparkSession)
    scored = predict(docs, train(docs))
    return scored.select("doc_id", (c.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")

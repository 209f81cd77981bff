"""Scores against plain Python, one byte or sentence at a time, fed with the same parameters."""

import math
import re

import numpy as np
import pytest

from reachkit.llm import common as c
from reachkit.llm import langid, toxicity
from tests.llm.conftest import prose

M = (1 << 64) - 1


def gru_probabilities(net, block):
    """Per position the languages' probabilities: both recurrences written out."""
    h = langid.HIDDEN
    sig = lambda a: 1 / (1 + math.exp(-a))
    states = [[None] * len(block) for _ in range(2)]
    for d in range(2):
        s = [0.0] * h
        for t in range(len(block)) if d == 0 else reversed(range(len(block))):
            x = [*s, *(float(v) for v in net.embed[d, :, block[t]]), 1.0]
            a = [sum(float(w) * v for w, v in zip(row, x, strict=True)) for row in net.w[d]]
            new = [math.tanh(a[2 * h + k] + sig(a[h + k]) * a[3 * h + k]) for k in range(h)]
            s = [(s[k] - new[k]) * sig(a[k]) + new[k] for k in range(h)]
            states[d][t] = s
    out = []
    for t in range(len(block)):
        x = [*states[0][t], *states[1][t], 1.0]
        z = [sum(float(w) * v for w, v in zip(row, x, strict=True)) for row in net.out]
        e = [math.exp(v - max(z)) for v in z]
        out.append([v / sum(e) for v in e])
    return out


def test_language_scores_byte_by_byte(spark):
    net = langid.Network.start(["aa", "bb", "cc"], np.random.default_rng(2))
    rng = __import__("random").Random(2)
    rows = [(1, prose(rng, 40)), (2, "É ñ 日本"), (3, "x"), (4, "1 2 3"), (5, None), (6, "")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()}
    for i, text in rows:
        raw = (text or "").encode()
        if not any(ch.isalpha() for ch in text or ""):
            assert got[i] == ("und", 0.0)
            continue
        p = [q for k in range(0, len(raw), langid.BLOCK) for q in gru_probabilities(net, raw[k:k + langid.BLOCK])]
        mean = [sum(q[k] for q in p) / len(raw) for k in range(3)]
        assert got[i][0] == net.langs[int(np.argmax(mean))] and got[i][1] == pytest.approx(max(mean), abs=1e-4)


def test_masked_gradients():
    rng = np.random.default_rng(3)
    net = langid.Network.start(["a", "b"], rng)
    net.embed, net.w, net.out = (x.astype(np.float64) for x in (net.embed, net.w, net.out))
    x, y = rng.integers(97, 103, (7, 4)).astype(np.uint8), rng.integers(0, 2, 4)
    mask = (np.arange(7)[:, None] < np.array([7, 3, 1, 5])[None, :]).astype(np.float32)
    x[mask == 0] = 0
    _, grads = net.gradients(x, y, mask)
    for part, grad in ((net.out, grads[2]), (net.embed, grads[0])):
        for _ in range(6):
            at = tuple(int(rng.integers(0, s)) for s in part.shape)
            if part is net.embed:
                at = (at[0], at[1], int(x[0, at[1] % 4]))
            old, e = part[at], 2e-2
            part[at] = old + e
            up = net.gradients(x, y, mask)[0]
            part[at] = old - e
            down = net.gradients(x, y, mask)[0]
            part[at] = old
            assert grad[at] == pytest.approx((up - down) / (2 * e), abs=3e-3)
    # what lies behind the end does not matter
    x[mask == 0] = 99
    assert all(np.allclose(a, b) for a, b in zip(net.gradients(x, y, mask)[1], grads, strict=True))


def test_language_of_short_texts_is_learned(spark):
    rng = __import__("random").Random(4)
    words = {"aa": ["sol", "mar", "luz", "paz"], "bb": ["kwik", "zork", "wuk", "kzz"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(5))[:20], lang) for i in range(300) for lang in (("aa", "bb")[i % 2],)]
    rows += [(7, "same text again here", "aa")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {(r.doc_id, r.lang_pred) for r in langid.digest(docs).collect()}
    right = sum((i, lang) in out for i, _, lang in rows[:300])
    assert right > 285


def word_hash(word: bytes) -> int:
    base, total = 0x9E3779B97F4A7C15 | 1, 0
    for k, b in enumerate(word):
        total = (total + int(c._BYTE[b]) * pow(base, k, 1 << 64)) & M
    x = (total + len(word)) & M
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor & M
    return x ^ (x >> 31)


def test_toxicity_sentence_by_sentence(spark):
    rng = __import__("random").Random(5)
    rows = [(1, prose(rng, 60)), (2, "Bad words here! nothing there. bad\nBAD?"), (3, None), (4, "..!"), (5, "bad " * 50), (6, "ñandú bad")]
    hashes = sorted({word_hash(w) for w in (b"bad", b"words", b"w7", "ñandú".encode())}
                    | {word_hash(b"w12"[:4]) ^ (0x51ED270B27D4EB4F & M), word_hash(b"nothi") ^ (0x51ED270B27D4EB4F * 2 & M)})
    model = toxicity.Model(np.array(hashes, np.uint64), np.linspace(-1, 4, len(hashes)), -3.0)
    weight = dict(zip(hashes, np.linspace(-1, 4, len(hashes)).tolist(), strict=True))
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        scores = []
        for sentence in re.split(r"[.!?\n]", low):
            found = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", sentence)]
            if found:
                z = -3.0 + sum(weight.get(word_hash(w), 0.0) for w in found)
                z += sum(weight.get(word_hash(w[:n]) ^ (0x51ED270B27D4EB4F * (k + 1) & M), 0.0)
                         for w in found for k, n in enumerate(toxicity.PREFIXES))
                scores.append(1 / (1 + math.exp(-z)))
        want = 1 - math.prod(1 - p for p in scores)
        assert got[i].score == pytest.approx(want, abs=1e-9) and got[i].n_sentences == len(scores)
        if scores:
            assert got[i].worst_sentence == int(np.argmax(scores)) + 1 and got[i].worst_score == pytest.approx(max(scores))

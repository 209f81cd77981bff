"""Trained operators: gradients, normalisation, recall, held-out accuracy, edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachkit.llm import ann, langid, language_model, toxicity
from tests.conftest import SF_CHECK
from tests.llm import brute


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


# ---------------------------------------------------------------- nearest neighbours

def nearest(vectors, every=20, top=20):
    out = []
    for i, v in vectors:
        if i % every == 0:
            best = sorted((-float(np.einsum("j,j->", np.array(u, float), np.array(v, float))), j) for j, u in vectors if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best[:top])]
    return sorted(out)


def vector_rows():
    rng = random.Random(6)
    good = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    good += [(60 + i, [1.0] + [0.0] * 5) for i in range(30)]  # ties
    bad = [(100, None), (120, [0.0] * 6), (140, [1.0, None] + [0.0] * 4), (160, [float("nan")] * 6),
           (180, [float("inf")] + [0.0] * 5), (200, []), (220, [1.0, 2.0]), (None, [1.0] * 6)]
    return good, bad


def test_search_is_exact_where_all_cells_are_walked(spark):
    good, bad = vector_rows()
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumn("v", F.lit("x")).withColumn("c1", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.digest(df.repartition(3)).collect())
    want = nearest(good)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=1e-12)
    assert sum(a[2] == b[2] for a, b in zip(got, want, strict=True)) > 0.99 * len(want)
    tied = [x[2] for x in got if x[0] == 60]
    assert tied[-5:] == sorted(tied[-5:])


def test_search_in_small_blocks_gives_the_same(spark):
    good, _ = vector_rows()
    v = ann.usable(spark.createDataFrame(good, "vec_id long, embedding array<double>"))
    dim, books = ann.fit(v, centroids=4)
    entries = ann.index(v, dim, books)
    asked = entries.where("vec_id % 20 = 0")
    a = ann.search(entries, asked, dim, books, top=5, visit=30, share=0).collect()
    b = ann.search(entries, asked, dim, books, top=5, visit=30, share=0, block_rows=7).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and a


def test_recall(spark):
    df = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    rows = [(r.vec_id, r.v) for r in ann.usable(df).collect()]
    got = {}
    for r in ann.digest(df, visit=20, share=0.45).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = {}
    for i, _, j, _ in nearest(rows):
        want.setdefault(i, set()).add(j)
    assert set(got) == set(want)
    assert sum(len(got[i] & want[i]) for i in want) >= 0.85 * sum(map(len, want.values()))  # 0.9 and more on larger tables


def test_recall_where_a_third_of_the_rows_are_copies(spark):
    rng = np.random.default_rng(14)
    one = rng.normal(size=(6001, 64))
    one /= np.linalg.norm(one, axis=1)[:, None]
    x = np.concatenate([one[1:], np.repeat(one[:1], 3000, 0)])
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.digest(df.repartition(4), every=20, visit=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    near, hot = [], []
    for k in np.flatnonzero(ids % 20 == 0):
        if k < 6000 and x[k] @ one[0] < 0:
            continue  # those near the copies walk their cell early
        score = np.einsum("ij,j->i", x, x[k])
        order = np.lexsort((ids, -score))
        want = ids[order[ids[order] != ids[k]][:20]].tolist()
        mine = [i for _, i in sorted(got[ids[k]])]
        if k < 6000:
            near.append(len(set(mine) & set(want)) / 20)
        else:  # copies find copies, the smallest ids first
            hot.append(mine == want)
    assert hot and all(hot) and np.mean(near) >= 0.9, np.mean(near)


def test_copies_are_one_entry_and_rows_of_their_own(spark):
    rows = [(i % 40, [1.0, 0.5]) for i in range(80)] + [(100 + i, [0.1 * i, 1.0]) for i in range(5)] + [(0, [1.0, 0.5])] * 50
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    dim, books = ann.fit(ann.usable(df))
    entries = ann.index(ann.usable(df), dim, books)
    held = {tuple(r.v): (r.ids, r.times) for r in ann.distinct(entries, 5).collect()}
    assert len(held) == 6 and held[1.0, 0.5] == ([0, 1, 2, 3, 4, 5], [5, 2, 2, 2, 2, 2])
    got = sorted((r.rank, r.vec_id) for r in ann.search(entries, entries.where("vec_id = 1").limit(1), dim, books, top=5).collect())
    assert [i for _, i in got] == [0] * 5
    got = sorted((r.rank, r.vec_id) for r in ann.search(entries, entries.where("vec_id = 20").limit(1), dim, books, top=60).collect())
    assert [i for _, i in got] == [0] * 52 + [1, 1, 2, 2, 3, 3, 4, 4]


def test_queries_are_dealt_to_bounded_parts(spark):
    rng = np.random.default_rng(16)
    rows = [(0, rng.normal(size=4).tolist()) for _ in range(400)] + [(i, rng.normal(size=4).tolist()) for i in range(1, 400)]
    rows += [rows[0], rows[500]] * 20  # a hot id, and repeated rows
    v = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    dim, books = ann.fit(v, centroids=4)
    entries = ann.index(v, dim, books)
    out = ann.search(entries, entries, dim, books, top=3, block_rows=50)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    plain = {}
    for r in ann.search(entries, entries, dim, books, top=3).collect():
        plain.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in plain.items()} and len(got) == 400
    x = np.array([u for _, u in rows])  # a query whose row is repeated: other rows once each
    mine = rows[500]
    score = sorted((-float(s), i) for s, (i, _) in zip(x @ np.array(mine[1]), rows, strict=True) if i != mine[0])[:3]
    assert [i for _, i, _ in sorted(got[mine[0]])] == [i for _, i in score]
    questions, n, parts = ann.parted(entries, 50)
    sizes = [r["count"] for r in questions.groupBy("part").count().collect()]
    assert n == len(rows) and parts == -(-n // 50) and sum(sizes) == 799 and max(sizes) <= 100
    plan = out._jdf.queryExecution().toString()
    assert re.search(r"FlatMapCoGroupsInArrow \[slab#\d+, block#\d+, part#\d+\]", plan)


def test_walk_takes_pairs_in_the_order_of_summed_distance():
    rng = np.random.default_rng(7)
    a, b, counts = rng.random(9), rng.random(7), rng.integers(0, 4, (9, 7))
    pairs = ann.walk(a, b, counts, 10 ** 9)
    sums = [a[i] + b[j] for i, j in pairs]
    assert sums == sorted(sums) and set(pairs) == set(zip(*map(list, np.nonzero(counts)), strict=True))
    some = ann.walk(a, b, counts, 20)
    assert some == pairs[:len(some)] and sum(counts[p] for p in some) >= 20 > sum(counts[p] for p in some[:-1])


def test_no_vectors(spark):
    assert ann.digest(spark.createDataFrame([(1, [0.0])], "vec_id long, embedding array<float>")).count() == 0


# ---------------------------------------------------------------- language model

def test_language_model_base_and_counts(spark, edge_docs, edges):
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                 for r in language_model.digest(edge_docs).collect())
    rows = [(i, brute.words(brute.low(t)) + [None]) for i, t in edges if i is not None]
    counts = Counter(w for i, ws in rows if fold(i, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i, fold(i, 7) == 2, len(ws), sum(counts[w] > 0 for w in ws), n,
                   sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in rows)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert [x[5] for x in got] == pytest.approx([x[5] for x in want], rel=1e-9)
    assert all(x[6] < 0 for x in got)


def test_language_model_beats_the_base_on_held_out_texts(spark):
    out = language_model.digest(spark.read.parquet(f"{SF_CHECK}/documents.parquet"))
    sums = out.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert sums["s"] > 0.97 * sums["b"]


def test_language_model_is_normalised():
    """Probabilities of all symbols, and of all words of a class with its unseen share, sum to one."""
    unigram = np.random.default_rng(8).random(language_model.SYMBOLS)
    model = language_model.LogBilinear.start(unigram / unigram.sum())
    one, two, log_z = model.tables()
    for a, b in ((0, 5), (language_model.END, language_model.END), (900, 3)):
        assert np.exp(one[a].astype(float) + two[b] - log_z[a, b]).sum() == pytest.approx(1, abs=1e-4)
    # the class sums that vocabulary() builds
    words = {k: 1 + k % 5 for k in range(40)}
    total = sum(n + 1 for n in words.values()) + 1
    assert sum((n + 1) / total for n in words.values()) + 1 / total == pytest.approx(1)


def test_noise_contrastive_gradients():
    rng = np.random.default_rng(9)
    n = 12
    unigram = rng.random(n)
    unigram /= unigram.sum()
    model = language_model.LogBilinear.start(unigram)
    for x in ("context", "maps", "output", "bias"):
        setattr(model, x, getattr(model, x).astype(np.float64))
    c1, c2, w, noise = (rng.integers(0, n, 7) for _ in range(4))
    log_kq = np.log(7 * unigram)

    def loss():
        predicted = model.context[c1] @ model.maps[0] + model.context[c2] @ model.maps[1]
        true = (predicted * model.output[w]).sum(1) + model.bias[w] - log_kq[w]
        false = predicted @ model.output[noise].T + model.bias[noise] - log_kq[noise]
        return (np.log1p(np.exp(-true)).sum() + np.log1p(np.exp(false)).sum()) / len(w)

    for part, grad in zip(model.parts(), model.nce(c1, c2, w, noise, log_kq), strict=True):
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in part.shape)
            old, e = part[at], 1e-5
            part[at] = old + e
            up = loss()
            part[at] = old - e
            down = loss()
            part[at] = old
            assert grad[at] == pytest.approx((up - down) / (2 * e), abs=1e-6)


def test_language_model_empty(no_docs):
    assert language_model.digest(no_docs).count() == 0


# ---------------------------------------------------------------- language identification

def test_backpropagation_through_time():
    rng = np.random.default_rng(10)
    net = langid.Network.start(["a", "b", "c"], rng)
    x, y = rng.integers(97, 105, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = net.gradients(x, y)
    for part, grad in zip((net.embed, net.w, net.out), grads, strict=True):
        for _ in range(6):
            at = tuple(int(rng.integers(0, s)) for s in part.shape)
            if part is net.embed:
                at = (at[0], at[1], int(x[at[1] % 6, 0]))
            if part is net.w and (at[1] // langid.HIDDEN == 2) == (at[2] < langid.HIDDEN) and at[1] >= 2 * langid.HIDDEN:
                continue  # held at zero
            old, e = part[at], 2e-2
            part[at] = old + e
            up = net.gradients(x, y)[0]
            part[at] = old - e
            down = net.gradients(x, y)[0]
            part[at] = old
            assert grad[at] == pytest.approx((up - down) / (2 * e), abs=3e-3)


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    out = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_id_edge_cases(edge_docs, edges):
    rows = langid.digest(edge_docs).collect()
    assert len(rows) == len(edges)
    texts = {}
    for i, t in edges:
        texts.setdefault(i, t)
    for r in rows:
        letters = any(ch.isalpha() for ch in texts[r.doc_id] or "")
        assert (r.lang_pred == "und") == (not letters) and r.lang_pred in ("und", "aa", "bb")
        assert r.held_out == (None if r.doc_id is None else fold(r.doc_id, 4) == 2)


def test_blocks_pool_like_single_positions(spark):
    """Batches of many blocks with masks give each document what it gives alone."""
    rng = np.random.default_rng(12)
    net = langid.Network.start(["a", "b"], rng)
    texts = [rng.integers(97, 123, n).astype(np.uint8) for n in (1, 127, 128, 129, 300, 5)]
    end = np.cumsum([len(t) for t in texts])
    p = langid._pooled(net, np.concatenate(texts), end - [len(t) for t in texts], end)
    for t, got in zip(texts, p, strict=True):
        blocks = [net.probabilities(net.states(t[i:i + langid.BLOCK][:, None], None))[:, :, 0] for i in range(0, len(t), langid.BLOCK)]
        assert np.concatenate(blocks, 1).mean(1) == pytest.approx(got, abs=1e-5)
        assert len(langid.position_labels(net, t.tobytes())) == len(t)


def test_language_id_without_anything_learned(spark, no_docs):
    assert langid.digest(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.digest(docs).collect()} == {("und", 0.0)}


# ---------------------------------------------------------------- toxicity

def test_noisy_or_finds_the_offending_feature():
    rng = np.random.default_rng(13)
    n_docs, per = 400, 6
    y = (rng.random(n_docs) < 0.3).astype(int)
    doc, sentence, feature = [], [], []
    for d in range(n_docs):
        for s in range(per):
            doc.append(d)
            sentence.append(s)
            feature.append(int(rng.integers(1, 20)))
        if y[d]:
            doc.append(d)
            sentence.append(int(rng.integers(per)))
            feature.append(0)
    weights, bias = toxicity.fit_noisy_or(y, np.full(n_docs, per), np.array(doc), np.array(sentence), np.array(feature), 20)
    assert weights[0] + bias > 1 and (weights[1:] + bias).max() < -3


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF_CHECK.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.digest(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in out if r.toxic == 1]
    clean = [r.predicted for r in out if r.toxic == 0]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02


TOXIC = [(i, f"a fine day it is. you {w}! more to say here." if i % 3 == 0 else "a fine day it is. more to say here, you.", w)
         for i, w in ((i, ("scum", "trash")[i % 2]) for i in range(120))]


def toxic_tables(spark):
    more = [(500, None), (501, ""), (None, "scum"), (502, "?!")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in [(i, t) for i, t, _ in TOXIC] + more],
                                 "doc_id long, text string, score string, toxic string")
    rows = [(i, None, int(i % 3 == 0)) for i, _, _ in TOXIC] + [(None, 1, 1), (3, 1, None), (500, 0, 0), (9, None, 0)]
    return docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_edge_cases_and_sentences(spark):
    docs, labels = toxic_tables(spark)
    rows = {r.doc_id: r for r in toxicity.digest(docs, labels).collect()}
    assert len(rows) == len(TOXIC) + 4
    for i, _, _ in TOXIC:
        assert rows[i].predicted == int(i % 3 == 0), i
        assert rows[i].held_out == (fold(i, 4) == 2)
        if i % 3 == 0:
            assert rows[i].worst_sentence == 2
    assert all(rows[i].score == 0 for i in (500, 501, 502)) and rows[None].held_out is None
    model = toxicity.train(docs, labels)
    found = toxicity.offending_sentences(docs, model).where("doc_id is not null").collect()
    assert {r.doc_id for r in found} == {i for i, _, _ in TOXIC if i % 3 == 0}
    assert all(r.text.strip() in ("you scum!", "you trash!") and r.sentence == 2 for r in found)
    kept = toxicity.remove_toxic(docs, labels, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in TOXIC if i % 3} | {500, 501, 502}


def test_toxicity_sample_holds_both_labels_and_is_bounded(spark):
    """Few toxic labels among many, a hot id, repeated rows and labels without a document."""
    rows = [(i, f"a fine day it is{i}. you {('scum', 'trash')[i // 100 % 2]}! more to say." if i % 100 == 0
             else f"a fine day it is{i}. more to say here, you.") for i in range(3000)]
    docs = spark.createDataFrame(rows + [rows[1]] * 500 + [(2, f"another fine text {i}.") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 100 == 0)) for i in range(3000)] + [(10_000 + i, 1) for i in range(500)],
                                   "doc_id long, toxic int")
    held = toxicity._labelled(docs.repartition(3), labels, 200).collect()
    kinds = Counter(r.toxic for r in held)
    assert kinds[0] == 100 and kinds[1] == sum(i % 100 == 0 and fold(i, 4) != 2 for i in range(3000))
    assert len({(r.doc_id, r.text) for r in held}) == len(held)
    model = toxicity.train(docs, labels, 200)
    out = {(r.doc_id, r.score >= toxicity.THRESHOLD) for r in toxicity.score(docs, model).collect()}
    assert out == {(i, i % 100 == 0) for i in range(3000)}


def test_toxicity_held_out_with_a_balanced_sample(spark):
    docs, labels = (spark.read.parquet(f"{SF_CHECK.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels, 800))
    out = scored.join(labels.select("doc_id", "toxic"), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).collect()
    hit = {k: np.mean([r.score >= toxicity.THRESHOLD for r in out if r.toxic == k]) for k in (0, 1)}
    assert hit[1] > 0.85 and hit[0] < 0.02, hit


def test_toxicity_without_labels(spark):
    docs, labels = toxic_tables(spark)
    assert {r.score for r in toxicity.digest(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.digest(docs.limit(0), labels).count() == 0

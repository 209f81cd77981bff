"""Spelling variants, ranked lexical search and SimHash against plain statements."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachkit.llm import lexical, simhash, spelling
from tests.llm import brute
from tests.llm.conftest import CLASHING, prose


def clashing(df):
    for name in CLASHING:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


# ---------------------------------------------------------------- spelling variants

def misspelt_rows(seed=5):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzéñÉß"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 11))) for _ in range(120)]
    rows = []
    for i in range(300):
        out = []
        for _ in range(rng.randrange(0, 80)):
            word = base[min(int(rng.expovariate(0.05)), len(base) - 1)]
            if rng.random() < 0.2:
                j = rng.randrange(len(word))
                word = rng.choice([word[:j] + word[j + 1:], word[:j] + rng.choice("aeé") + word[j:], word[:j] + rng.choice("aeé") + word[j + 1:]])
            out.append(word.upper() if rng.random() < 0.1 else word)
        rows.append((i, " ".join(out)))
    long = "xy" * 3000
    return rows + [(None, "ignored words here " * 9), (7000, None), (7001, ""), (7002, "123 .,"), (7003, f"{long} " * 6),
                   (7004, f"{long}z " * 40), (7004, f"{long}z " * 40), (7005, "maçã÷maçã×a " * 7), (7007, "chaining " * 150 + "chaininx " * 26 + "chainixx " * 5), (7006, "日本語 abcdefg " * 6)]


def as_variants(df):
    rows = [r.asDict() for r in df.collect()]
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def misspelt(spark):
    rows = misspelt_rows()
    return rows, clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_spelling_variants(misspelt):
    rows, df = misspelt
    want = brute.spelling(rows)
    assert sum(v[0] is not None for v in want.values()) > 20
    assert any(v[0] is not None and v[1] != v[0] for v in want.values())  # a chain of forms
    assert as_variants(spelling.digest(df)) == want


def test_spelling_in_small_blocks(misspelt):
    rows, df = misspelt
    vocab = spelling.vocabulary(df)
    whole = {tuple(r) for r in spelling.near_pairs(vocab).collect()}
    parts = spelling.near_pairs(vocab, groups=5, prefix=2, block=7, task_rows=50).collect()
    assert {tuple(sorted(r[:2])) for r in parts} == {tuple(sorted(r[:2])) for r in whole}
    assert len(parts) == len(whole) == sum(v[3] for v in brute.spelling(rows).values()) // 2


def test_near_words():
    pairs = [("abc", "abc"), ("abc", "abd"), ("abc", "ab"), ("ab", "abc"), ("abc", "bc"), ("aab", "ab"), ("abc", "acb"), ("abc", "xbd"),
             ("a", ""), ("", ""), ("a", "b"), ("é" * 300, "é" * 299), ("abcd", "ab"), ("abcd", "bcda"), ("xa", "ax"), ("xax", "ax")]
    got = spelling.is_near([a.encode("latin-1") for a, _ in pairs], [b.encode("latin-1") for _, b in pairs])
    assert got.tolist() == [False, True, True, True, True, True, False, False, True, False, True, True, False, False, False, True]


def test_spelling_empty(spark, no_docs):
    assert spelling.digest(no_docs).collect() == []


# ---------------------------------------------------------------- ranked search

def searched(spark, rows, items, **more):
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    bench = clashing(spark.createDataFrame(items, "item_id long, text string"))
    return sorted(tuple(r) for r in lexical.search(docs, bench, **more).select("item_id", "rank", "doc_id", "score").collect())


def search_items(edges):
    rng = random.Random(11)
    return [(1, prose(rng, 40)), (2, "One two words É 日本語 one one"), (3, None), (4, ""), (5, " .,;"), (6, "nowhere-to-be-found xyzzy"),
            (7, edges[9][1]), (7, "ab ab ab"), (8, edges[5][1]), (9, prose(rng, 5)), (9, prose(random.Random(1), 3)), (None, "one"), (1, prose(random.Random(11), 40))]


def test_ranked_search(spark, edges):
    items = search_items(edges)
    assert searched(spark, edges, items) == brute.ranked(edges, items)


def test_ranked_search_in_small_trees_and_blocks(spark, edges):
    rng = random.Random(2)
    rows = edges + [(1000 + i, prose(rng, rng.randrange(1, 60), 60)) for i in range(300)] + [(2000 + i, "w1 w2 w3 w4") for i in range(120)]
    items = search_items(edges)
    want = brute.ranked(rows, items)
    assert searched(spark, rows, items, group_items=2, chunk_rows=40, seed_docs=60, block_terms=100) == want


def test_ball_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 4, (12, 50)) * 10 ** 9
    rows = np.maximum(centres[rng.integers(0, 12, 3000)] + rng.integers(-10 ** 6, 10 ** 6, (3000, 50)), 0)
    rows[:, 0] += 1
    ptr = np.concatenate([[0], np.cumsum((rows > 0).sum(1))])
    tree = lexical.BallTree(ptr, np.nonzero(rows)[1], rows[rows > 0], 50, leaf=32)
    ids = rng.permutation(3000)
    queries = rng.integers(0, 3, (50, 20))
    bound = tree.bounds(queries.astype(float))
    exact = rows @ queries
    for node, mine in enumerate(tree.rows):
        assert (exact[mine].max(0) <= bound[node]).all()
    leaves = sum(x is None for x in tree.children)
    visited = 0
    for k in range(20):
        best, scored = tree.search(bound[:, k], queries[:, k], ids, 10, 1)
        visited += scored
        order = np.lexsort((ids, -exact[:, k]))[:10]
        assert [(-s, i) for s, i, _ in best] == [(int(exact[o, k]), int(ids[o])) for o in order]
    assert visited < 0.5 * 20 * leaves


def test_ranked_search_empty(spark, no_docs, edge_docs):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert lexical.digest(no_docs, bench).collect() == []
    assert lexical.digest(edge_docs, bench.limit(0)).collect() == []


# ---------------------------------------------------------------- SimHash

def test_simhash(edge_docs, edges):
    got = sorted(tuple(r) for r in simhash.digest(edge_docs).collect())
    assert got == brute.simhash(edges)


def test_simhash_pairs_of_dense_fingerprints(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (600, 3)).astype(np.uint64))
    many = np.bitwise_xor.reduce(flips * rng.integers(0, 2, (600, 3)).astype(np.uint64), axis=1) ^ base[rng.integers(0, 6, 600)]
    many = np.unique(np.concatenate([many, rng.integers(0, 1 << 63, 400, dtype=np.uint64), np.zeros(1, np.uint64)]))
    rows = [(int(x), i) for i, x in enumerate(many.view(np.int64))]
    df = spark.createDataFrame(rows, "fp long, rep long").repartition(4)
    want = {(min(a, b), max(a, b)) for i, (a, _) in enumerate(rows) for b, _ in rows[i + 1:]
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert len(want) > 1000
    for more in ({}, {"salt_rows": 5}, {"n_parts": 4}, {"n_parts": 2}):
        got = [tuple(r) for r in simhash.near_pairs(df, **more).collect()]
        assert len(got) == len(want) and set(got) == want, more


def test_simhash_names_the_whole_ball_where_buckets_are_crowded(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CANDIDATE_COST", 1e6)
    rows = [(x, i) for i, x in enumerate([0, 1, 3, 7, 1 << 40, -1, -2, 1 << 63 - 1])]
    df = spark.createDataFrame(rows, "fp long, rep long")
    want = {(min(a, b), max(a, b)) for i, (a, _) in enumerate(rows) for b, _ in rows[i + 1:]
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert {tuple(r) for r in simhash.near_pairs(df).collect()} == want


def test_thresholds_are_the_cheapest_that_sum_up():
    import itertools

    rng = np.random.default_rng(4)
    for parts, total in ((3, 0), (4, -1), (2, 1), (1, 2)):
        cost = rng.random((50, parts, 4)) * 100
        cost[:, :, 0] = 0
        chosen, value = simhash.allocate(cost, total)
        assert (chosen.sum(1) == total).all()
        for q in range(50):
            least = min(sum(cost[q, i, t + 1] for i, t in enumerate(ts)) for ts in itertools.product((-1, 0, 1, 2), repeat=parts) if sum(ts) == total)
            assert abs(value[q] - least) < 1e-9
            assert abs(sum(cost[q, i, t + 1] for i, t in enumerate(chosen[q])) - least) < 1e-9


def test_simhash_document_with_two_texts_joins_them(spark):
    rng = random.Random(8)
    a, b = prose(rng, 200), prose(rng, 200)
    rows = [(5, a), (5, b), (2, a), (9, b), (11, prose(rng, 150)), (12, None), (13, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.digest(df).collect()) == brute.simhash(rows)


def test_simhash_long_text_and_empty(spark, no_docs):
    rng = random.Random(9)
    rows = [(1, prose(rng, 150_000)), (2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.digest(df).collect()) == brute.simhash(rows)
    assert simhash.digest(no_docs).collect() == []

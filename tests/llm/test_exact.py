"""Operators with exact results, against brute force, on edge cases and small tables."""

import random
import zlib

import numpy as np
import pytest

from reachkit.llm import decontaminate, neardup, packing, runindex, substring, wavelet
from reachkit.llm.catalog import tokenizer
from reachkit.llm.components import connected_components
from reachkit.llm.encoder import encoder
from tests.llm import brute
from tests.llm.conftest import prose


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_substring(edge_docs, edges):
    got = rows_of(substring.digest(edge_docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring(edges)
    assert sum(r[2] for r in got) > 0


def test_substring_windows_longer_than_all_texts(edge_docs, edges):
    got = rows_of(substring.digest(edge_docs, 7000), "doc_id", "n_removed")
    assert all(n == 0 for _, n in got) and len(got) == sum(i is not None for i, _ in edges)


def test_deduplicate_keeps_clean_rows_and_columns(edge_docs, edges):
    out = substring.deduplicate(edge_docs)
    assert out.columns == edge_docs.columns
    rows = out.collect()
    assert len(rows) == len(edges)
    want = {i: (n, removed, sha) for i, n, removed, sha in brute.substring(edges)}
    before = {}
    for i, t in edges:
        before.setdefault(i, t)
    for r in rows:
        if r.doc_id is not None:
            assert brute.sha(" ".join(brute.words(r.text))) == want[r.doc_id][2]
        if r.doc_id is None or want[r.doc_id][1] == 0:
            assert r.text == before[r.doc_id]


def test_run_length_index(edge_docs, edges):
    got = rows_of(runindex.digest(edge_docs, 100), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.byte_spans(edges, 100)


def test_run_length_index_hot_anchors_and_small_shards(edge_docs):
    def covered(df):
        out = {}
        for r in df.collect():
            out.setdefault((r.doc_id, r.tid), set()).update(
                p for a, b in zip(r.spans[::2], r.spans[1::2], strict=True) for p in range(a, b))
        return out

    plain = covered(runindex.repeated_spans(edge_docs, 100))
    assert plain and plain == covered(runindex.repeated_spans(edge_docs, 100, shard_bytes=2000, hot_bytes=300))


def test_repeated_rows_are_collected_once(spark, edges):
    rows = [(i, t) for i, t in edges if i in (9, 10, 13, 15)]
    hot = [x for x in rows if x[0] in (10, 15)]
    twice, often = (spark.createDataFrame(rows + hot * n, "doc_id long, text string").repartition(3) for n in (1, 40))
    for spans, name in ((lambda d: runindex.repeated_spans(d, 100), "spans"), (lambda d: substring.late_windows(d, 50), "starts")):
        few, many = (sorted((r.doc_id, r.tid, len(r[name])) for r in spans(d).collect()) for d in (twice, often))
        assert few == many and {x[0] for x in few} & {10, 15}


def _statistics(parts):
    out = []
    places = [(p, i) for p, t in enumerate(parts) for i in range(len(t))]
    for p, i in places:
        best = 0
        for q, j in places:
            if (p, i) != (q, j):
                n = 0
                while i + n < len(parts[p]) and j + n < len(parts[q]) and parts[p][i + n] == parts[q][j + n]:
                    n += 1
                best = max(best, n)
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_matching_statistics_and_counts(seed):
    rng = np.random.default_rng(seed)
    parts = [bytes(rng.integers(97, 98 + seed % 3, int(rng.integers(0, 50))).astype(np.uint8)) for _ in range(6)]
    parts += parts[:seed % 3]
    end = np.cumsum([len(p) for p in parts])
    index = runindex.RunLengthIndex(np.frombuffer(b"".join(parts), np.uint8), end - [len(p) for p in parts], end)
    got = index.matching_statistics()
    flat = [int(got[index.first[p] + i]) for p, t in enumerate(parts) for i in range(len(t))]
    assert flat == _statistics(parts)
    for pattern in (b"a", b"ab", b"aa", b"aba", b"c", b"zz"):
        assert index.count(pattern) == sum(t.startswith(pattern, k) for t in parts for k in range(len(t)))


def test_near_duplicates(edge_docs, edges):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.digest(edge_docs).collect()}
    assert got == brute.components(edges)
    assert got[13][1] == got[14][1] == got[15][1] == 13


def test_near_duplicates_around_the_threshold(spark):
    """A large group of copies with edits: many pairs just above and just below the threshold."""
    rng = random.Random(1)
    base = prose(rng, 120, 5000).split(" ")
    rows = []
    for i in range(120):
        w = list(base)
        for p in rng.sample(range(len(w)), rng.choice([0, 2, 3, 4, 6, 9])):
            w[p] = f"edit{i}x{p}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute.components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.digest(docs).collect()} == want
    signed = neardup._signed(docs, 4, neardup.BANDS * neardup.ROWS)
    reps, labels = neardup.links(docs, signed, block=16)  # buckets cut into blocks
    named = {r.node: r.component for r in labels.collect()}
    assert all(named.get(r.rep, r.rep) == want[r.rep][1] for r in reps.collect())


def test_bayes_bounds():
    grid = np.linspace(0, 1, 200_001)
    for m, n in ((20, 26), (40, 52), (26, 26), (3, 26)):
        density = grid ** m * (1 - grid) ** (n - m)
        assert neardup.posterior(m, n, 0.8) == pytest.approx(density[grid >= 0.8].sum() / density.sum(), abs=1e-4)
    least = neardup.least_matches(26, 0.8, 1e-6)
    assert neardup.posterior(least, 26, 0.8) >= 1e-6 > neardup.posterior(least - 1, 26, 0.8)


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    edges += [(2000, 2000 + i) for i in range(50)] + [(5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x or any(root(y) == x for y in up if y != x)}


def test_keep_one_keeps_columns_and_clean_rows(edge_docs, edges):
    out = neardup.keep_one(edge_docs)
    assert out.columns == edge_docs.columns
    want = brute.components(edges, 5)
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, _ in edges if i is not None and want[i][1] == i)
    assert ids.count(None) == 1


ITEMS = "item_id long, text string, ws string, count string"


def items_for(edges):
    texts = dict(edges)
    return [(1, " ".join(texts[9].split()[5:30])), (2, "one"), (3, None), (4, "--- !!"), (5, texts[5][:400]),
            (None, texts[13]), (6, "é É"), (7, "Two  WORDS"), (1, "a second row of item one that is nowhere found in these texts at all"),
            (8, " ".join(["ab"] * 14))]


def test_contamination(spark, edge_docs, edges):
    items = items_for(edges)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEMS)
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute.contamination(edges, items)
    assert rows_of(decontaminate.digest(edge_docs, df), *cols) == want
    assert rows_of(decontaminate.contamination(edge_docs, df, broadcast_bytes=0), *cols) == want  # the shuffle join
    bad = {r[0] for r in want if r[-1]}
    out = decontaminate.decontaminate(edge_docs, df)
    assert out.columns == edge_docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(i) for i, _ in edges if i not in bad)


def test_contamination_runs_no_python(spark, edge_docs, edges):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in items_for(edges)], ITEMS)
    plan = decontaminate.digest(edge_docs, df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def coded(rows, path, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4") for i, x in rows if i is not None}


@pytest.mark.parametrize("name, style", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaced")])
def test_chunked_encoding_is_the_tokenizers(name, style):
    import pyarrow as pa

    from reachkit.llm import common as c

    rng = random.Random(4)
    alphabet = "ab Z\n\t  é \u0085　 'st1日à́.,\x1c<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(600)]
    code = encoder(tokenizer(name), style)
    ids, count = code(*c.flat(pa.array(texts)))
    stop = np.cumsum(count)
    for t, b, n in zip(texts, stop, count, strict=True):
        assert code.tokenizer.encode(t, add_special_tokens=False).ids == ids[b - n:b].tolist(), repr(t)
    code._shrink(np.sort(np.concatenate([h for h, _ in code.known])[:50]))
    again, _ = code(*c.flat(pa.array(texts)))
    assert (again == ids).all()


@pytest.mark.parametrize("name, style", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaced")])
def test_added_tokens_in_a_text_are_the_librarys(name, style):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from reachkit.llm import common as c

    rng = random.Random(15)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|endof", "text|>", "<|", "|>", "<", "a", "Zed",
              " ", "  ", "\n", "é", "e\u0301", "\u0301", "\u3000", "\u0085", "'s", "1", "."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(1500)]
    texts += ["x <|endof", "text|> y", "<|endoftext|>", "", "a<|endoftext|><|endoftext|> b"]  # literals do not cross rows
    plain = Tokenizer.from_file(tokenizer(name))
    ids, count = encoder(tokenizer(name), style)(*c.flat(pa.array(texts)))
    stop = np.cumsum(count)
    for t, b, n in zip(texts, stop, count, strict=True):
        assert plain.encode(t, add_special_tokens=False).ids == ids[b - n:b].tolist(), repr(t)
    assert (ids == plain.token_to_id("<|endoftext|>")).sum() > 100


def test_packing_and_wavelet_with_added_tokens(spark):
    from tokenizers import Tokenizer

    rows = [(1, "one <|endoftext|> two"), (2, "<|startoftext|>Three<|endoftext|>"), (3, "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, end in (("word_bpe_49k.json", wavelet.END_ID), ("byte_bpe_50k.json", None)):
        plain, start, want = Tokenizer.from_file(tokenizer(name)), 0, []
        for i, t in rows:
            ids = plain.encode(t, add_special_tokens=False).ids
            want.append((i, start, len(ids) + 1, zlib.crc32(np.array(ids + [end or 0], "<u4").tobytes())))
            start += len(ids) + 1
        if end is not None:
            assert rows_of(wavelet.digest(docs, tokenizer(name)), "doc_id", "start", "n_tokens", "ids_crc32") == want
        else:
            assert rows_of(packing.pack(docs, tokenizer(name)), "doc_id", "doc_tokens", "ids_crc32") == [(i, n, x) for i, _, n, x in want]


def test_wavelet_round_trip(edge_docs, edges):
    path = tokenizer("word_bpe_49k.json")
    want, start, out = coded(edges, path, 2), 0, []
    for i, _ in sorted((x for x in edges if x[0] is not None), key=lambda x: x[0]):
        out.append((i, start, len(want[i]), zlib.crc32(want[i].tobytes())))
        start += len(want[i])
    got = wavelet.read_shards(wavelet.write_shards(edge_docs, path, shard_tokens=500))
    assert rows_of(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(out)


@pytest.mark.parametrize("n, top", [(0, 5), (1, 1), (700, 1), (3000, 40), (5000, 60_000)])
def test_wavelet_matrix(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
    assert (m.to_array() == ids).all()
    for i in range(0, n, max(1, n // 20)):
        assert m.access(i) == ids[i]
        assert m.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
    for value in {int(x) for x in ids[:3]} | {top + 1}:
        assert m.count(value) == (ids == value).sum()
        assert m.occurrences(value) == np.flatnonzero(ids == value).tolist()
    with pytest.raises(IndexError):
        m.select(top + 1, 0)


def check_packing(out, tokens, window):
    cover, sequences = {}, {}
    for r in out:
        ids = tokens[r.doc_id][r.start:r.start + r.length]
        assert len(ids) == r.length > 0 and zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.doc_tokens == len(tokens[r.doc_id])
        cover.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= window
    assert sorted(sequences) == list(range(len(sequences)))
    return cover, sequences


def test_packing(edge_docs, edges):
    path = tokenizer("byte_bpe_50k.json")
    tokens = coded(edges, path, 0)
    cover, sequences = check_packing(packing.pack(edge_docs, path, group_pieces=20).collect(), tokens, 1024)
    assert sorted(cover) == sorted(tokens)
    for i, pieces in cover.items():
        rows = sum(j == i for j, _ in edges)
        assert sorted(pieces)[::rows] == [(a, min(1024, len(tokens[i]) - a)) for a in range(0, len(tokens[i]), 1024)]


def test_best_fit_decreasing_takes_the_tightest_window():
    rng = random.Random(5)
    sizes = sorted((rng.randrange(1, 101) for _ in range(500)), reverse=True)
    number, offset = packing.best_fit_decreasing(sizes, 100)
    room = []
    for size, k, at in zip(sizes, number, offset, strict=True):
        fits = [r for r in room if r >= size]
        if fits:
            assert room[k] == min(fits) and at == 100 - room[k]
        else:
            assert k == len(room) and at == 0
            room.append(100)
        room[k] -= size
    assert sum(room) < 0.03 * 100 * len(room)


def test_empty_tables(spark, no_docs):
    items = spark.createDataFrame([], ITEMS)
    for df in (substring.digest(no_docs), runindex.digest(no_docs), neardup.digest(no_docs),
               decontaminate.digest(no_docs, items), wavelet.digest(no_docs, tokenizer("word_bpe_49k.json")),
               packing.pack(no_docs, tokenizer("byte_bpe_50k.json")), substring.deduplicate(no_docs), neardup.keep_one(no_docs)):
        assert df.count() == 0


def test_no_benchmark(spark, edge_docs):
    out = decontaminate.digest(edge_docs, spark.createDataFrame([], ITEMS)).collect()
    assert out and not any(r.contaminated or r.n_hit or r.n_items for r in out)


def _template(rng, size, change):
    """Documents of one template in which ``change`` of ``size`` words differ everywhere."""
    body = [f"t{i}" for i in range(size)]
    places = rng.sample(range(size), change)

    def one(i):
        mine = list(body)
        for p in places:
            mine[p] = f"x{i}_{p}"
        return " ".join(mine)
    return one


def test_documents_with_two_texts_join_their_copies(spark):
    rng = random.Random(4)
    a, b = prose(rng, 300), prose(rng, 300)
    near = lambda t: t.replace(t.split(" ")[150], "changed", 1)
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (7, prose(rng, 200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted({(r.doc_id, r.component_id) for r in neardup.digest(docs).collect()})
    assert got == [(1, 1), (2, 1), (3, 1), (7, 7)]


def test_template_group_below_the_threshold_leaves_no_pairs(spark, monkeypatch):
    """2,000 documents of similarity 0.75 with one another, and two true copies among them."""
    rng = random.Random(6)
    one = _template(rng, 400, 15)
    rows = [(i, one(i)) for i in range(2000)] + [(5000, one(77) + " tail"), (5001, one(78) + " tail")]
    sets = [brute.shingles(rows[i][1], 4) for i in (0, 1)]
    assert 0.7 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.79
    emitted = {}
    stored = neardup.c.stored

    def counting(df, name, *more):
        out = stored(df, name, *more)
        if name in ("neardup-likely", "neardup-rest", "neardup-links"):
            emitted[name] = out.count()
        return out

    monkeypatch.setattr(neardup.c, "stored", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.digest(docs).collect()}
    assert {i: k for i, k in got.items() if i != k} == {5000: 77, 5001: 78}
    # of two million pairs, the task gives away a forest per bucket at first, and then two links
    assert emitted["neardup-likely"] <= 26 * len(rows) and emitted["neardup-rest"] <= 26 * len(rows)
    assert emitted["neardup-links"] <= 4

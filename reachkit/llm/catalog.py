"""Registered queries of the corpus operators (``opN_<name>``) and, where SQL can say it, their
DuckDB cross-checks.  Each query applies its operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reachkit.llm import common as c
from reachkit.llm import (
    ann,
    decontaminate,
    langid,
    language_model,
    lexical,
    neardup,
    packing,
    runindex,
    simhash,
    spelling,
    substring,
    toxicity,
    wavelet,
)


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.digest(c.table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(c.table(spark, sf_dir, "documents"))


def op3_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.digest(c.table(spark, sf_dir, "documents"))


def op4_bigru_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(c.table(spark, sf_dir, "documents"))


def op5_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.digest(c.table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels"))


def op7_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.digest(c.table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(c.table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.digest(c.table(spark, sf_dir, "documents"))


def op10_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))


def op11_frequency_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(c.table(spark, sf_dir, "documents"))


def op12_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.digest(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))


def op13_pigeonhole_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(c.table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_inverted_multi_index, op2_substring_dedup, op3_log_bilinear, op4_bigru_language_id, op5_wavelet_matrix,
    op6_mil_toxicity, op7_bayes_minhash, op8_best_fit_packing, op9_run_length_index, op10_prefix_decontamination,
    op11_frequency_trie, op12_ball_tree_search, op13_pigeonhole_simhash)}

ORACLE_SQL = {
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS h
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
firsts AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
late AS (SELECT DISTINCT win.doc_id, i + d AS p FROM win JOIN firsts USING (h), range(50) r(d)
         WHERE firsts.lo < win.doc_id),
pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s FROM pos ANTI JOIN late USING (doc_id, p) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM late GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)""",
    "op10_prefix_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 12], ' ') AS s, least(len(ws), 13) AS n
        FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes)),
hit AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN win USING (s, n)),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(13) r(k) WHERE k < n GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(it, ',' ORDER BY it) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS it FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_bayes_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
        GROUP BY 1, 2),
link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(doc_id, t) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.t = link.a),
low AS (SELECT doc_id, min(t) AS component_id FROM reach GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN low USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op9_run_length_index": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS m
        FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM d)),
twice AS (SELECT m FROM win GROUP BY m HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM win SEMI JOIN twice USING (m)),
edge AS (SELECT doc_id, i, sum(CASE WHEN i - p <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
         FROM (SELECT doc_id, i, lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM hit)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM edge GROUP BY doc_id, g),
ends AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM span),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS s, max(b) AS last,
                sum(b - a) AS removed, count(*) AS spans
         FROM ends JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed,
       coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(s, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_frequency_trie": r"""
WITH RECURSIVE rule AS (SELECT list_transform(range(256), lambda b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
                 lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END, b::UBIGINT)) AS crc),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents WHERE text IS NOT NULL),
per AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, k, xor(list_reduce(flatten(list_transform(string_split(doc_id || ':' || run, ''),
                 lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::UBIGINT] ELSE [195::UBIGINT, (unicode(ch) - 64)::UBIGINT] END)),
             lambda a, b: xor(a >> 8, crc[((xor(a, b) & 255) + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS h FROM per, rule),
cut AS (SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
             ELSE run END AS word FROM hashed),
v AS (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
hole AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM hole a JOIN hole b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
         UNION SELECT hole.word, v.word, v.n FROM hole JOIN v ON hole.s = v.word
         UNION SELECT v.word, hole.word, hole.n FROM hole JOIN v ON hole.s = v.word),
best AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near FROM near
         QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * n THEN other END AS form,
                 CASE WHEN m >= 5 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
walk(word, place) AS (SELECT word, word FROM forms
                   UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON walk.place = forms.word WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, walk.place AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk ON walk.word = f.word JOIN forms last ON walk.place = last.word WHERE last.form IS NULL""",
    "op12_ball_tree_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
k AS (SELECT count(*)::BIGINT AS n, sum(len(ws))::BIGINT AS l FROM d WHERE len(ws) > 0),
tf AS (SELECT doc_id, len(ws)::BIGINT AS size, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, ws, unnest(ws) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * k.n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), k),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * size * k.n) // k.l))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term), k GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
}

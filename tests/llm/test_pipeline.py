"""The pipeline's stages take effect, in order, on what the stage before kept."""

import __spark_entry__ as entry
import corpus_pipeline
from reachkit.llm import common as c
from reachkit.llm.catalog import QUERIES, tokenizer
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.test_exact import check_packing, coded


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").where("toxic = 1").collect()}
    columns, before = docs.columns, docs
    texts = [[(r.doc_id, r.text) for r in before.collect()]]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = c.stored(stage(spark, before, SF_SMALL), f"test-{name}")
        assert before.columns == columns
        texts.append([(r.doc_id, r.text) for r in before.collect()])
    all_, clean, single, cut, kept = texts
    gone = {i for i, _ in all_} - {i for i, _ in clean}
    assert toxic and len(gone & toxic) >= 0.5 * len(toxic) and len(gone - toxic) < 0.6 * len(all_)
    want = brute.components(clean, 5)
    assert sorted(i for i, _ in single) == sorted(i for i, (_, k) in want.items() if i == k)
    words = {i: sha for i, _, _, sha in brute.substring(single)}
    assert {i: brute.sha(" ".join(brute.words(t))) for i, t in cut} == words
    bad = {r[0] for r in brute.contamination(cut, items) if r[-1]}
    assert sorted(i for i, _ in kept) == sorted(i for i, _ in cut if i not in bad)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF_SMALL).collect()
    cover, _ = check_packing(packed, coded(kept, tokenizer("byte_bpe_50k.json"), 0), 1024)
    assert sorted(cover) == sorted(i for i, _ in kept)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_SMALL).count() > 0

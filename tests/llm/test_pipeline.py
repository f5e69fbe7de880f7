import os
import sys

import corpus_pipeline
import numpy as np
import pytest

from spindrel.llm import bpe, decontaminate

sys.path.insert(0, os.path.dirname(__file__))
from test_ngram_jaccard import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with rows added that have nulls, repeats and nothing in them."""
    out = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(None, None, None, None, None), (9001, "", "en", "s", 0), (9002, "12 34", None, "s", 5), (None, docs.first().text, "en", None, 1), (9003, "A short clean text about the house and the river.", "en", "s", 1), (9003, "A short clean text about the house and the river.", "en", "s", 1)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{out}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{out}/{t}.parquet")
    return out


def test_stages_against_plain_rules(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_copies", "benchmark", "packing"] and corpus_pipeline.ORACLE_SQL is None
    now = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.save(stage(spark, now, folder), f"test-{name}")
        kept[name] = (now.collect(), out.collect())
        if name != "packing":
            assert out.schema.simpleString() == now.schema.simpleString()
        now = out
    before, after = kept["language"]
    gone = [r for r in before if r not in after]
    assert all(not any(c.isalpha() for c in r.text or "") for r in gone) and len(gone) == 3
    before, after = kept["quality"]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    ids = {r.doc_id for r in after}
    right = [(r.doc_id in ids) == (quality[r.doc_id] == 1) for r in before if r.doc_id in quality]
    assert np.mean(right) > 0.95
    before, after = kept["near_copies"]
    known = [(r.doc_id, r.text) for r in before if r.doc_id is not None]
    classes = brute(dict(known).items(), 5, 80)
    unnamed = {r.text for r in before if r.doc_id is None}
    left = [r.doc_id for r in after if r.doc_id is not None]
    assert len(left) == len(set(left))
    texts = dict(known)
    for doc, (_, component) in classes.items():
        members = {d for d, (_, c) in classes.items() if c == component}
        if not any(texts[d] in unnamed for d in members):
            assert (doc in left) == (doc == component)
        else:
            assert not members & set(left)
    assert sum(r.doc_id is None for r in after) == len(unnamed)
    before, after = kept["benchmark"]
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in before if any(i in decontaminate.plain(r.text) for i in items)}
    assert leaked and not leaked & {r.doc_id for r in after} and len(before) - len(after) == len(leaked)
    before, after = kept["packing"]
    count = lambda t: len(bpe.encoder(bpe.default_path()).text(t)) // 4 + 1
    assert sum(p.length for p in after) == sum(count(r.text) for r in before)


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0

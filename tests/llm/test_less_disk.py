import random

import pytest

from spindrel.llm import ngram_jaccard
from test_component_paths import folders
from test_crowded_columns import crowd
from test_ngram_jaccard import brute, corpus


@pytest.mark.parametrize("seed", [1, 2])
def test_common_phrases_crowd_nobody(spark, monkeypatch, seed):
    """Different texts that share common phrases have rare shingles too; these enter the product, so none goes to the second one."""
    r = random.Random(seed)
    phrases = [" ".join(f"c{r.randrange(90)}" for _ in range(8)) for _ in range(12)]
    docs = [(i, " ".join(r.choice(phrases) if j % 2 else " ".join(f"r{r.randrange(10**6)}" for _ in range(2)) for j in range(24))) for i in range(160)]
    docs += [(200 + i, docs[i][1] + " end") for i in range(20)]
    monkeypatch.setattr(ngram_jaccard, "_within_clusters", lambda *a: pytest.fail("crowded"))
    members, _ = ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90, longest=4)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in members.collect()} == brute(docs, 3, 90)


@pytest.mark.parametrize("small", [dict(OVERLAPS=1, WAVE=1), dict(BLOCK=1 << 9, PAIRS=128, LEAST=1, WAVE=8), dict(BITS=64, RANKED=8), dict(RANK_SAMPLE=2000, WHOLE_SAMPLE=100)])
def test_waves_find_the_same(spark, monkeypatch, small):
    for k, v in small.items():
        monkeypatch.setattr(ngram_jaccard, k, v)
    for docs, words, percent, longest in ((corpus(), 3, 80, 32), (crowd(), 3, 80, 16)):
        members, links = ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), words, percent, longest)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()} == brute(docs, words, percent)
        assert links.where("x = y").count() == 0


def test_files_of_the_join_are_deleted(spark):
    names = ("overlaps", "incidence", "reps", "pairs", "sets", "crowded-sets", "edges")
    before = {n: folders(spark, n) for n in names}
    ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(corpus(), "doc_id long, text string"), 3, 90)[0].collect()
    assert all(folders(spark, n) <= before[n] for n in names if n != "edges")

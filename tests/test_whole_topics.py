import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spindrel.operators import models, topics

DOCS = [(1, "The cat sees the dog"), (2, "Le chat voit le chien, le chat dort"), (3, "the house"), (4, "alone"), (5, None), (6, "rare words stand once; the cat")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents only, so a query that reads another table fails."""
    out = str(tmp_path_factory.mktemp("topics"))
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{out}/documents.parquet")
    return out


@pytest.mark.parametrize("held", [1 << 23, 8])
def test_cooccurrence_has_the_whole_vocabulary(spark, folder, held, monkeypatch):
    monkeypatch.setattr(topics, "HELD", held)
    v, total = defaultdict(int), Counter()
    for _, text in DOCS:
        n = Counter(re.findall("[a-z]+", (text or "").lower()))
        for i in n:
            for j in n:
                v[i, j] += n[i] * (n[j] - (i == j))
                total[i] += n[i] * (n[j] - (i == j))
    words = topics.tokens(spark, folder)
    got = {(r.i, r.j): (r.v, r.p) for r in topics.cooccurrence(words).collect()}
    assert got == {(i, j): (x, x / total[i] if total[i] else None) for (i, j), x in v.items()} and ("rare", "once") in got
    norms = {i: round(sum((x / total[i]) ** 2 for (k, _), x in v.items() if k == i) ** 0.5, 8) for i in total if total[i]}
    rows = {r.term: (r.partners, r.total, r.norm) for r in topics.CATALOG.queries["word_cooccurrence"](spark, folder).collect()}
    assert rows == {i: (sum(x > 0 for (k, _), x in v.items() if k == i), total[i], norms.get(i)) for i in total}
    assert topics.cooccurrence(words.limit(0)).count() == 0
    best = topics.CATALOG.queries["anchor_first"](spark, folder).first()
    assert (-best.norm, best.term) == min((-n, i) for i, n in norms.items())


def test_fits_read_all_documents_and_words(spark, folder):
    places = {(d, i, w) for d, text in DOCS for i, w in enumerate(re.findall("[a-z]+", (text or "").lower()))}
    words = {w for _, _, w in places}
    gibbs = topics.CATALOG.queries["lda_collapsed_gibbs"](spark, folder).collect()
    assert {(r.doc_id, r.pos, r.term) for r in gibbs} == places and len(gibbs) == len(places)
    tree = topics.CATALOG.queries["shtm_fit"](spark, folder).collect()
    assert {(r.node, r.term) for r in tree} == {(n, w) for n in range(7) for w in words}
    assert sum(r.val - 0.1 for r in tree) == pytest.approx(len(places))
    lda = models.CATALOG.queries["lda_baseline"](spark, folder).collect()
    assert {(r.topic, r["rank"]) for r in lda} == {(t, k) for t in range(3) for k in range(5)} and {r.term for r in lda} <= words
    assert all(len({r.term for r in lda if r.topic == t}) == 5 for t in range(3))


def test_partial_sums_of_pairs_are_exact():
    r = np.random.default_rng(1)
    for top in (10, 1 << 50):
        i, j, v = r.integers(0, 30, 5000) << 33, r.integers(0, 30, 5000) << 33, r.integers(0, top, 5000)
        expected = defaultdict(int)
        for a, b, x in zip(i.tolist(), j.tolist(), v.tolist()):
            expected[a, b] += x
        got = defaultdict(int)
        for a, b, x in zip(*(c.to_pylist() for c in topics._summed(i, j, v).columns)):
            got[a, b] += x
        assert got == expected

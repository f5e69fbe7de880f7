import random
import re

import pytest

from spindrel.llm.ngram_jaccard import ngram_jaccard_join


def brute(docs, words, percent):
    """Components and set sizes by comparing every pair."""
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while True:
        old = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if old == label:
            return {i: (len(sets[i]), label[i]) for i in sets}


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([4, 12, 40, 90]))] for _ in range(25)]
    docs = []
    for b in base:
        for _ in range(r.choice([1, 2, 14])):
            w = list(b)
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            docs.append(" ".join(w))
    docs += ["", None, " \n", "one", "ONE", "one two", "one  two", "same " * 50, "same " * 70, docs[3], docs[3].upper()]
    return list(enumerate(docs))


@pytest.mark.parametrize("words,percent,longest", [(3, 90, 32), (3, 90, 1), (5, 80, 2), (2, 70, 3)])
def test_matches_every_pair(spark, words, percent, longest):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as cls", "'x' as component_id", "2 as n")
    members, _ = ngram_jaccard_join(df, words, percent, longest)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()} == brute(docs, words, percent)


def test_empty_and_null_ids(spark):
    members, links = ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string"))
    assert members.count() == 0 and links.count() == 0
    members, _ = ngram_jaccard_join(spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id long, text string"))
    assert sorted((r.doc_id is not None, r.component_id) for r in members.collect() if r.n_shingles) == [(False, 4), (True, 4), (True, 4)]

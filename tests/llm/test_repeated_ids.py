import corpus_pipeline


def test_an_id_that_repeats_loses_only_its_copies(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a), (2, f"{a} more"), (2, b), (3, c), (3, f"{c} more"), (4, c), (4, c), (5, "12"), (None, b)]
    out = corpus_pipeline.distinct(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(x for x in left if x[0] in (1, 2, 5)) == [(1, a), (5, "12")] and (None, b) in left
    assert [x[0] for x in left if x[0] in (3, 4)] == [3]
    clean = corpus_pipeline.distinct(spark, spark.createDataFrame([(1, a), (2, f"{a} more"), (2, b)], "doc_id long, text string"), "")
    assert sorted((r.doc_id, r.text) for r in clean.collect()) == [(1, a), (2, b)]

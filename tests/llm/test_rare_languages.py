from spindrel.llm import langid
from spindrel.llm.sampling import least_by_hash_within


def test_a_rare_language_is_learned(spark):
    common = [(i, ("the cat and the dog " if i % 2 else "le chat et la souris ") * 4, "en" if i % 2 else "fr") for i in range(600)]
    df = spark.createDataFrame(common + [(1000, "zwölf boxkämpfer jagen viktor quer über den sylter deich", "de"), (1001, "12 34", "xx")], "doc_id long, text string, lang string")
    assert langid.train(df, sample=30).languages == ["de", "en", "fr"]


def test_samples_share_out_evenly_and_are_bounded(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id < 3 then 'a' when id < 50 then 'b' else 'c' end as lang")
    rows = least_by_hash_within(df, "lang", ["doc_id"], 90).collect()
    kinds = [r.lang for r in rows]
    assert (kinds.count("a"), kinds.count("b"), kinds.count("c")) == (3, 43, 44)
    assert {r.doc_id for r in rows} == {r.doc_id for r in least_by_hash_within(df.repartition(7), "lang", ["doc_id"], 90).collect()}

import duckdb
import pytest

from spindrel.operators import tables, topics

DOCS = [(1, "The cat sees the dog", "en"), (2, "Le chat voit le chien, LE chat dort", "fr"), (3, "the house of the cat", "en"), (4, "", "de"), (5, None, "en"), (6, "cat chat cat", "fr"), (7, "der Hund 7 cat", "de")]
NAMES = ["term_doc", "word_slots"]


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("name", NAMES)
def test_counts_of_documents_give_what_tokens_give(spark, tmp_path, name, repeated):
    docs = DOCS + ([(3, "a second text of the house", "fr")] if repeated else [])
    spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, "the cat and the chat")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    catalog = tables.CATALOG if name in tables.CATALOG.queries else topics.CATALOG
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    query = catalog.queries[name](spark, str(tmp_path))
    assert ("MapInArrow" in query._jdf.queryExecution().toString()) is not repeated
    want = sorted(db.execute(catalog.sql[name]).fetchall())
    got = sorted(tuple(r) for r in query.collect())
    assert got == [tuple(pytest.approx(x) if isinstance(x, float) else x for x in r) for r in want]

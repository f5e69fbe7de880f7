import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrel.llm import bpe, elias_fano, sharding, token_counts


def test_shards_are_written_and_read_back(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 40)) for i in range(500)] + [(None, None), (4, ""), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = str(tmp_path / "shards")
    sharding.write_shards(df, out, 7, seed=3, bucket_bytes=4000)
    dealt = sorted((r.shard, r.slot, r.doc_id or -1, r.text or "") for r in sharding.shuffle_shards(df, 7, seed=3, bucket_bytes=4000).collect())
    back = []
    for k in range(7):
        shard = sharding.read_shard(spark, out, k).orderBy("slot").collect()
        assert [r.slot for r in shard] == list(range(len(shard)))
        back += [(k, r.slot, r.doc_id or -1, r.text or "") for r in shard]
    assert back == dealt


def test_doc_ids_may_span_all_longs(spark):
    least, most = -(2**63), 2**63 - 1
    segment = elias_fano.Segment(elias_fano.dump_segment([None, least, -5, 0, most], [b"\x01\x00\x00\x00"] * 5, 4))
    assert segment.doc_ids() == [None, least, -5, 0, most] and [segment.names[i] for i in range(4)] == [0, 2**63 - 5, 2**63, 2**64 - 1]
    rows = [(least, "a"), (most, "b c"), (None, "n"), (0, None)] + [(None, f"n{i}") for i in range(40)]
    out = elias_fano.token_files(spark.createDataFrame(rows, "doc_id long, text string"), end=2).orderBy("start").collect()
    assert [r.doc_id for r in out if r.doc_id is not None] == [least, 0, most] and len(out) == 44
    assert np.array_equal(np.cumsum([0] + [r.n_tokens for r in out][:-1]), [r.start for r in out])


count = lambda t: len(bpe.encoder(bpe.default_path()).text(t)) // 4


@settings(max_examples=60, deadline=None)
@given(st.text("ab .\n\U0001d11e", max_size=300), st.lists(st.tuples(st.integers(-2, 320), st.integers(0, 60), st.text("cd \n", max_size=40)), max_size=4))
def test_stored_trees_go_on_where_they_stopped(text, edits):
    tree = token_counts.CountTree(text, count)
    for at, cut, put in edits:
        again = token_counts.CountTree.load(tree.dump(), count)
        assert (again.total, again.text(), len(again), again.encoded) == (tree.total, tree.text(), len(tree), 0)
        before = tree.encoded
        tree.edit(at, cut, put)
        again.edit(at, cut, put)
        assert (again.total, again.text()) == (tree.total, tree.text()) and again.total == count(again.text())
        assert again.encoded <= tree.encoded - before + 2 * token_counts.LEAF + 2 or " " not in text


def test_trees_of_one_job_are_edited_by_the_next(spark, tmp_path):
    rows = [(1, "some words here " * 300), (2, None), (2, "")]
    trees = token_counts.build_trees(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as tree2"), ["doc_id"])
    trees.write.parquet(str(tmp_path / "trees"))
    for turn in (1, 2):
        read = spark.read.parquet(str(tmp_path / ("trees" if turn == 1 else "later"))).selectExpr("*", "array(named_struct('at', 10 * doc_id, 'cut', 4, 'put', 'new words')) as edits")
        out = token_counts.edit_trees(read, ["doc_id"])
        if turn == 1:
            out.write.parquet(str(tmp_path / "later"))
    text = rows[0][1]
    for _ in range(2):
        text = text[:10] + "new words" + text[14:]
    got = {r.doc_id: r for r in out.where("doc_id = 1").collect()}[1]
    assert got.edited_tokens == count(text) and got.edited_chars == len(text) and got.encoded_again < 300
    assert sorted(r.edited_tokens for r in out.where("doc_id = 2").collect()) == [4, 4]
    assert token_counts.edit_trees(read.limit(0), ["doc_id"]).count() == 0

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spindrel.llm import bpe, elias_fano, packing, token_counts

ODD = ["", " ", None, "it's we'll DON'T", "a\x1cb \x85 c", "foo<|endoftext|>bar, x", "İstanbul ΣΑΣ é", "x" * 300, "a.b a.. 'S's x'll", "naïve CIÓN ñ 日本語 12 345", "end.\x0b\x0ctwo three", "éte"]


def whole(text):
    return Tokenizer.from_file(bpe.default_path()).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_the_librarys(text):
    assert np.frombuffer(bpe.encoder(bpe.default_path()).text(text), np.uint32).tolist() == bpe.encoder(bpe.default_path()).whole.encode(text, add_special_tokens=False).ids


def test_odd_texts_have_the_librarys_ids():
    for t in ODD:
        assert np.frombuffer(bpe.encoder(bpe.default_path()).text(t), np.uint32).tolist() == whole(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    ef, end = elias_fano.EliasFano.load(elias_fano.EliasFano.of(np.array(values, np.uint64)).dump(), 0)
    assert ef.all().tolist() == values and [ef[i] for i in range(len(values))] == values


def test_token_files_keep_order_nulls_and_repeats(spark):
    rows = [(5, "b c"), (None, "n"), (-3, ODD[3]), (5, "a"), (9, None), (7, ODD[9])]
    out = elias_fano.token_files(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start"), end=2).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, -3, 5, 5, 7, 9]
    at = 0
    for r, text in zip(out, ["n", ODD[3], "a", "b c", ODD[9], None]):
        assert (r.start, np.frombuffer(r.ids, np.uint32).tolist()) == (at, whole(text) + [2])
        at += r.n_tokens
    assert elias_fano.token_files(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@given(st.integers(0, 20_000), st.integers(1, 4096))
def test_cut_keeps_every_token(tokens, capacity):
    parts = packing.cut(tokens, capacity)
    assert sum(parts) == tokens and all(0 < p <= capacity for p in parts)


def test_packing_places_each_id_once(spark):
    rows = [(i, "word " * (i * 37 % 500)) for i in range(60)] + [(None, None), (3, ""), (4, "z " * 9000)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as length"), capacity=256, with_ids=True)
    got = pieces.collect()
    by_sequence = {}
    for p in got:
        assert p.length * 4 == len(p.ids) and zlib.crc32(p.ids) == p.ids_crc32
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert sum(p.length for p in got) == sum(len(whole(t)) + 1 for _, t in rows)
    assert sum(p.length for p in got) > 0.9 * 256 * len(by_sequence)
    assert sum(len(r.ids) // 4 for r in packing.sequences(pieces).collect()) == sum(p.length for p in got)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text("ab .\n", max_size=400), st.lists(st.tuples(st.integers(-2, 420), st.integers(0, 60), st.text("cd \n", max_size=90)), max_size=6))
def test_counts_under_edits_are_those_of_the_whole_text(text, edits):
    count = lambda t: len(bpe.encoder(bpe.default_path()).text(t)) // 4
    tree = token_counts.CountTree(text, count)
    for at, cut, put in edits:
        at = max(0, min(at, len(text)))
        text = text[:at] + put + text[max(at, min(at + cut, len(text))) :]
        tree.edit(at, cut, put)
        assert tree.text() == text and tree.total == count(text) and len(tree) == len(text)


def test_count_tokens_table(spark):
    rows = [(1, "some words here " * 200, [(5, 3, "x")]), (2, None, None), (3, "a b", [None, (None, 1, None)]), (3, "a b", [])]
    df = spark.createDataFrame(rows, "n_tokens long, text string, edits array<struct<at:long,cut:long,put:string>>")
    out = token_counts.count_tokens(df.withColumnRenamed("n_tokens", "doc_id"), ["doc_id"]).collect()
    assert [(r.n_tokens, r.edited_tokens) for r in out][1:] == [(0, 0), (2, 1), (2, 2)]
    assert out[0].encoded_again < 200

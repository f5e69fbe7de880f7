import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrel.llm import decontaminate, html_blocks, langid, merkle, quality, sharding
from spindrel.llm.components import components


def test_components_match_union(spark):
    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 60, (45, 2))] + [(0, i) for i in range(100, 140)] + [(7, 7), (None, 3)]
    label = {x: x for e in edges for x in e if None not in e}
    for _ in range(200):
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {x: label[x] for x in linked}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_shards_are_a_seeded_permutation(spark):
    rows = [(i, "t" * (i * 31 % 900)) for i in range(1003)] + [(None, None), (4, ""), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as slot", "1 as __at2")
    out = [(r.doc_id, r.shard, r.slot) for r in sharding.shuffle_shards(df, 16, seed=3, bucket_bytes=20_000).collect()]
    again = [(r.doc_id, r.shard, r.slot) for r in sharding.shuffle_shards(df.repartition(7), 16, seed=3, bucket_bytes=20_000).collect()]
    assert Counter(out) == Counter(again) and len(out) == 1006
    sizes = Counter(s for _, s, _ in out)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(x for _, k, x in out if k == s) == list(range(n))
    place = {(s, x): d for d, s, x in out}
    order = [place[k] or 0 for k in sorted(place)]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.1
    assert sharding.shuffle_shards(df.limit(0)).count() == 0
    assert [(r.shard, r.slot) for r in sharding.shuffle_shards(df.limit(1)).collect()] == [(0, 0)]


@settings(max_examples=60, deadline=None)
@given(st.text("abd.\n h", max_size=300))
def test_merkle_trees_survive_a_dump(text):
    tree = merkle.Tree.of(text)
    again = merkle.Tree.load(tree.dump())
    assert again.root == tree.root and again.dump() == tree.dump()
    assert "".join(p for line in text.split("\n") for p in merkle.phrases(line)) == text.replace("\n", "")


def test_edits_are_located():
    lines = [f"line {i} has words and more of them at the end." for i in range(60)]
    other = lines[:30] + ["a changed line stands here now."] + lines[31:]
    a, b = merkle.Tree.of("\n".join(lines)), merkle.Tree.of("\n".join(other))
    assert a.root != b.root and merkle.likeness(a, b) > 0.9
    places = merkle.differing(a, b)
    assert len(places) == 1 and sum(len(s) for s in a.sections[: places[0][0]]) + places[0][1] == 30
    assert merkle.likeness(a, merkle.Tree.of("nothing alike")) == 0


def test_edited_fingerprints_match_the_plain_rule(spark):
    rows = [(i * 3 % 101, f"text number {i} " * (i % 17)) for i in range(101)] + [(200, None), (201, "ü€𝄞" * 9)]
    got = {r.doc_id: r for r in merkle.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part")).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        assert got[doc].edited_sha256 == hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest() and got[doc].n_chars == len(text)
        assert got[doc].fingerprint == merkle.Tree.of(text).dump()
    assert merkle.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = merkle.edited_fingerprints(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"aba").hexdigest()
    same = merkle.edited_fingerprints(spark.createDataFrame([(None, "x y z"), (2, "x y z"), (2, "x y z")], "doc_id long, text string")).collect()
    assert len(same) == 3 and len({r.fingerprint for r in same}) == 1


def brute_edits(a, b):
    """Fewest edits that make a of some stretch of b."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_match_brute_force(spark):
    r = np.random.default_rng(4)
    words = ["".join(r.choice(list("abcdefghij"), r.integers(2, 8))) for _ in range(150)]
    prose = lambda n: " ".join(r.choice(words, n))
    items = [(i, prose(n)) for i, n in enumerate([12, 25, 60, 3])] + [(4, None), (5, ""), (6, "Tiny")]
    docs = []
    for i in range(60):
        text = prose(80)
        if i % 3 == 0:
            leak = items[i // 3 % 4][1]
            chars = list(leak)
            for _ in range(i % 5):
                chars[r.integers(len(chars))] = "z"
            text += " " + "".join(chars).upper() + ", " + prose(30)
        docs.append((i, text))
    docs += [(98, None), (99, ""), (100, "so tiny!"), (100, "so tiny!"), (101, "tinyish")]
    expected = set()
    for doc, text in docs:
        p = decontaminate.plain(text or "")
        for item, t in items:
            codes = decontaminate._codes(decontaminate.plain(t or ""))
            for a, b in decontaminate.parts(codes):
                part = "".join(map(chr, codes[a:b]))
                if len(part) < decontaminate.Q:
                    hit = f" {part} " in f" {p} "
                else:
                    k = 0 if len(part) < decontaminate.SHORT else len(part) * decontaminate.EDITS // 100
                    hit = brute_edits(part, p) <= k
                if hit:
                    expected.add((doc, item))
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as edits"), spark.createDataFrame(items, "item_id long, text string"), least=1)
    rows = [(x.doc_id, x.item_id) for x in found.collect()]
    assert set(rows) == expected and Counter(rows)[100, 6] == 2
    clean = decontaminate.drop_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), least=1)
    assert {x.doc_id for x in clean.collect()} == {d for d, _ in docs} - {d for d, _ in expected}
    assert decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_long_texts_are_read_in_windows():
    r = np.random.default_rng(8)
    words = ["".join(r.choice(list("abcdefgh"), r.integers(2, 8))) for _ in range(300)]
    items = [(i, " ".join(r.choice(words, 30))) for i in range(5)] + [(9, "tiny")]
    text = " ".join(" ".join(r.choice(words, 200)) + f" {items[i % 6][1]}" for i in range(24))
    index = decontaminate.Index(items, least=1)
    whole = index.find(text, 10**9)
    assert {x[0] for x in whole} == {0, 1, 2, 3, 4, 9}
    parts = index.find(text, 700)
    assert {(i, e, k) for i, _, e, k in parts if i == 9 or k == 0} == {(i, e, k) for i, _, e, k in whole if i == 9 or k == 0}


def numeric(model, loss, key, at):
    keep = model.p[key].copy()
    out = []
    for s in (1e-2, -1e-2):
        model.p[key] = keep.copy()
        model.p[key][at] += s
        out.append(loss())
    model.p[key] = keep
    return (out[0] - out[1]) / 2e-2


def test_byte_network_gradient_and_learning():
    net = langid.Network(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, y, w = r.integers(97, 101, (7, 3)).astype(np.uint8), np.array([0, 1, 0]), np.full((7, 3), 1 / 21)
    _, g = net.gradient(x, y, w)
    for key, at in (("Ef", (98, 3)), ("Uf", (2, 5)), ("Eb", (99, 12)), ("Ub", (1, 14)), ("Vf", (3, 1)), ("b", (0,))):
        assert g[key][at] == pytest.approx(numeric(net, lambda: net.gradient(x, y, w)[0], key, at), rel=2e-2, abs=1e-5)
    net = langid.Network(["a", "b"])
    net.fit([(b"abab abab abba", 0), (b"cdcd dccd cdcd", 1)] * 20, rounds=60)
    p = net.probabilities([b"abba" * 300, b"", b"dcdc", "cd".encode() * 999])
    assert p.argmax(1)[[0, 2, 3]].tolist() == [0, 1, 1] and p[1].sum() == 0


def test_language_table(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "le chat et la souris ") * 4, "en" if i % 2 else "fr") for i in range(60)] + [(None, None, None), (61, "123 !", "en"), (62, "", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score2", langid.held_out())
    out = langid.identify(df, langid.train(df), ["doc_id", "lang"]).collect()
    assert all(r.lang_pred == r.lang for r in out if r.doc_id is not None and r.doc_id < 60)
    assert [r.lang_pred for r in out if r.doc_id is None or r.doc_id > 60] == ["und"] * 3
    assert langid.identify(df.limit(0), langid.train(df.limit(0)), ["doc_id"]).count() == 0


def test_quality_separates_and_bears_anything(spark):
    r = np.random.default_rng(2)
    good = ["".join(r.choice(list("abcdefg hij klm."), 300)) for _ in range(60)]
    bad = ["".join(r.choice(list("#$%&* AB!"), 300)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(good + bad + [None, "", "ok", "\x00" * 50])), "doc_id long, text string").selectExpr("*", "1 as label")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 100, 2)] + [(1, None), (None, 1), (2, 1)], "doc_id long, quality int")
    out = {x.doc_id: x.score for x in quality.score(docs, quality.train(docs, labels), ["doc_id"]).collect()}
    assert all(out[i] > 0.7 for i in range(60)) and all(out[i] < 0.3 for i in range(60, 100)) and all(0 <= s <= 1 for s in out.values())
    one = quality.train(docs, labels.where("quality = 1"))
    assert quality.score(docs, one, ["doc_id"]).count() == 104
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels), ["doc_id"]).count() == 0


def test_blocks_read_broken_pages():
    texts = lambda h: [b.text for b in html_blocks.blocks(h)]
    assert texts("<p>a<b> b<br>c<p>d &amp; e&nbsp;f</p><script>x<p>y</p></script><!-- <p>no</p> --><ul><li>1<li>2</ul>") == ["a b c", "d & e f", "1", "2"]
    assert texts("") == [] and texts("plain  text\n only") == ["plain text only"]
    assert texts("<div>a<span>b</span><div>c</div>d</div><p>cut <a href='x") == ["ab", "c", "d", "cut"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table><style>p{}</style><textarea><p>no</textarea>") == ["1 2", "3"]


def test_labeller_gradient():
    r = np.random.default_rng(5)
    pages = html_blocks.features([html_blocks.blocks(html_blocks.made_page(r)[0]) for _ in range(2)])
    model = html_blocks.Labeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    y = np.zeros((max(len(p[3]) for p in pages), 2), bool)
    y[1] = True
    _, g = model.gradient(pages, y)
    for key, at in (("N", (1, 3)), ("Wf", (2, 5)), ("Uf", (1, 20)), ("Wb", (4, 40)), ("Ub", (3, 60)), ("v", (40,)), ("c", (0,))):
        assert g[key][at] == pytest.approx(numeric(model, lambda: model.gradient(pages, y)[0], key, at), rel=3e-2, abs=1e-5)


def test_main_text_table(spark):
    page = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div><article><h1>A title</h1><p>First &lt;paragraph&gt; with some words of text.</p><p>Second one,   in\nfull length as well.</p></article><section class='comments'><p>nice post</p></section><footer>&copy; site</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", ""), (1, "u", page)], "page_id long, text string, html string")
    out = html_blocks.main_text(df.withColumnRenamed("text", "url"), ["page_id", "url"]).collect()
    assert out[0].text == "A title\n\nFirst <paragraph> with some words of text.\n\nSecond one, in full length as well." and out[0].n_chars == len(out[0].text)
    assert [r.text for r in out[1:3]] == ["", ""] and out[3] == out[0]
    assert html_blocks.main_text(df.limit(0), ["page_id"]).count() == 0


def test_made_pages_are_labelled_right():
    r = np.random.default_rng(123)
    made = [html_blocks.made_page(r) for _ in range(60)]
    found = [html_blocks.blocks(p) for p, _ in made]
    right = total = 0
    for blocks, keep, (_, texts) in zip(found, html_blocks.trained().main(found), made):
        known = {" ".join(t.split()) for t in texts}
        right += sum((b.text in known) == k for b, k in zip(blocks, keep))
        total += len(blocks)
    assert right > 0.98 * total



import time
import zlib

import numpy as np

from spindrel.llm import html_blocks

#: Pages written by hand, by other templates than the made pages', and their main blocks.
PAGES = [
("""<html><head><title>River news</title></head><body class=home>
<header id=site-header><a href=/>River News</a><form action=/search><input name=q><button>Go</button></form></header>
<nav class=main><ul><li><a href=/a>World</a><li><a href=/b>Sport</a><li><a href=/c>Weather</a></ul></nav>
<div id=cookie-banner><p>We use cookies to make this site better. <a href=/p>Privacy policy</a></p><button>Accept</button></div>
<main><article class=story><h1>The river rose again on Monday</h1><p>After two days of rain, the river rose above its banks, and the lower road was closed.</p><p>"It is the third time this year," said a farmer whose fields lie beside the water.</p>
<h2>What comes next</h2><p>More rain is forecast for the weekend, and the town has asked people to move their cars.</p></article>
<section class=comments><h3>Comments</h3><div class=comment><p>I saw it from the bridge, it was very high indeed.</p></div></section></main>
<aside class=sidebar><h3>Most read</h3><ul><li><a href=/1>Bridge repaired</a></li><li><a href=/2>New school opens</a></li></ul></aside>
<footer><p>&copy; River News. All rights reserved.</p></footer></body></html>""",
 ["The river rose again on Monday", "After two days of rain, the river rose above its banks, and the lower road was closed.", '"It is the third time this year," said a farmer whose fields lie beside the water.', "What comes next", "More rain is forecast for the weekend, and the town has asked people to move their cars."]),
("""<!doctype html><body><div class="wrapper"><div class="top-bar"><span class="logo">Kitchen Diary</span></div><div class="menu"><a href="/">Home</a> <a href="/r">Recipes</a> <a href="/c">Contact</a></div>
<div class="post"><h1 class="entry-title">Bread with three flours</h1><div class="entry-content"><p>This bread needs a long rest, so begin in the evening.</p><ul><li>300 g of rye flour</li><li>200 g of wheat flour</li><li>half a spoon of salt</li></ul><p>Mix the flours, add the water, and knead the dough until it is smooth.</p><blockquote><p>A slow dough makes a good crust.</p></blockquote></div></div>
<div class="share-buttons"><a href="/f">Share</a><a href="/t">Post</a></div>
<div id="newsletter"><p>Subscribe to our newsletter</p><form><input type=email><button>Sign up</button></form></div>
<ol class="comment-list"><li><p>Mine came out rather dense, what did I do wrong?</p></li><li><p>Try more water next time.</p></li></ol>
<div class="footer">Imprint | Privacy | Terms</div></div></body>""",
 ["Bread with three flours", "This bread needs a long rest, so begin in the evening.", "300 g of rye flour", "200 g of wheat flour", "half a spoon of salt", "Mix the flours, add the water, and knead the dough until it is smooth.", "A slow dough makes a good crust."]),
("""<html><body><div class="ad">Buy now: shoes at half the price</div><nav><a href="/">Start</a><a href="/docs">Docs</a></nav><main><h1>How to set up the clock</h1>
<p title=it's>Press the left button for three seconds, and the display will blink.</p><p>Then turn the wheel until the hour is right.</p>
<div class="advertisement"><p>Sponsored: the best batteries in town</p></div>
<p>When you are done, press the button again. The clock keeps its time for about two years.</p><table><tr><td>Button<td>Left</tr></table></main><footer>Clock Works Ltd, all rights reserved</footer></body></html>""",
 ["How to set up the clock", "Press the left button for three seconds, and the display will blink.", "Then turn the wheel until the hour is right.", "When you are done, press the button again. The clock keeps its time for about two years.", "Button Left"]),
("""<div id=page><div id=header><h2><a href=/>My small weblog</a></h2></div><div id=content><div class=post><h2>A walk in the hills</h2><p>We left early, before the sun was up, and took the path by the mill.<p>At noon we reached the top; the view went on for miles.<p>On the way down we met a shepherd, who told us about the winter of his youth.</div></div>
<div id=sidebar><h3>Archive</h3><ul><li><a href=/1>May</a><li><a href=/2>June</a></ul><h3>Tags</h3><ul><li><a href=/t>hills</a></ul></div><div id=comments><h3>2 responses</h3><ol><li class=comment><p>Lovely pictures.</p></ol><form id=respond><p>Leave a reply</p><textarea></textarea></form></div><div id=footer><p>Powered by a small engine</p></div></div>""",
 ["A walk in the hills", "We left early, before the sun was up, and took the path by the mill.", "At noon we reached the top; the view went on for miles.", "On the way down we met a shepherd, who told us about the winter of his youth."]),
("""<html><body><ul class="breadcrumbs"><li><a href="/">Home</a></li><li><a href="/law">Law</a></li></ul><div class="alert">This site will be down on Sunday.</div><section id="main-content"><header><h1>Notice periods in rental law</h1></header><p>A tenant can end a contract with a notice of three months, unless the contract says otherwise.</p><h3>Exceptions</h3><p>For furnished rooms in the landlord's own flat the period is two weeks.</p><p>The notice has to be in writing.</p></section><aside class="related"><h4>Related articles</h4><p><a href="/x">Deposits and what they cover</a></p></aside><footer class="site-footer"><ul><li><a href="/i">Imprint</a></li><li><a href="/p">Privacy</a></li></ul></footer></body></html>""",
 ["Notice periods in rental law", "A tenant can end a contract with a notice of three months, unless the contract says otherwise.", "Exceptions", "For furnished rooms in the landlord's own flat the period is two weeks.", "The notice has to be in writing."]),
]


def texts(page):
    return [b.text for b in html_blocks.blocks(page)]


def test_pages_written_by_hand():
    model = html_blocks.trained()
    for page, main in PAGES:
        assert html_blocks.extract([page], model) == ["\n\n".join(main)]


def test_quotes_count_only_after_an_equals_sign():
    assert texts("<p>one</p><p class=x title=it's>two</p><p>three</p><p>four isn't lost</p>") == ["one", "two", "three", "four isn't lost"]
    assert texts("<p title = 'a>b' id=\"c>d\"e='f>'>g</p><p '>h</p><a href=>i</a>") == ["g", "h", "i"]
    assert texts("<script>if (a<b) x=\"</script><p>in full</p>") == ["in full"]
    assert texts("a<!-->b<!-- <p>no</p> --!>c</ p>d<?x?>e<!doctype y>f") == ["abcdef"]
    assert texts("3 < 4 and 5<6") == ["3 < 4 and 5<6"]


def test_time_grows_with_the_page():
    def seconds(page):
        began = time.process_time()
        html_blocks.blocks(page)
        return time.process_time() - began

    for make in (lambda n: "<div>text " * n, lambda n: "<div>" * n + "<li>x</li>" * n + "</b>" * n, lambda n: "<b>" * n + "<div>y</div>" * n, lambda n: '<a "' * n, lambda n: "<!--" * n + "<a b" * n):
        short, long = seconds(make(5_000)), seconds(make(40_000))
        assert long < 24 * short + 0.5


def test_main_matches_a_plain_forward_pass():
    """Blocks of one page, read one step after the other with scalars for gates, against the batched reading of many pages."""
    model = html_blocks.trained()
    p = {k: v.astype(float) for k, v in model.p.items()}
    u = html_blocks.UNITS
    s = lambda a: 1 / (1 + np.exp(-a))
    found = [html_blocks.blocks(page) for page, _ in PAGES] + [html_blocks.blocks("<p>a word</p>" * 90)]
    keep = model.main(found)
    for page, got in zip(found, keep):
        x = []
        for i, b in enumerate(page):
            raw = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in b.text.encode())
            h, _ = html_blocks.word_hashes(raw, np.array([0, len(raw)]))
            a = sum(0.7 * p["E"][k] for k in (*b.path, zlib.crc32(f"leaf:{b.tag}".encode()) % html_blocks.PATHS))
            a = a + sum(2 / len(h) * p["E"][html_blocks.PATHS + int(k % np.uint64(html_blocks.WORDS))] for k in h)
            marks = sum(map(b.text.count, ".!?,;")) / len(b.text)
            x.append(np.tanh(a + np.array([np.log1p(len(b.text)) / 8, b.linked / len(b.text), np.log1p(len(h)) / 6, min(marks * 5, 0.3), i / len(page), 1]) @ p["N"]))
        states = {}
        for k, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            h, c = np.zeros(u), np.zeros(u)
            for t in order:
                a = x[t] @ p["W" + k] + h @ p["U" + k] + p["d" + k]
                c = s(a[u : 2 * u]) * c + s(a[:u]) * np.tanh(a[3 * u :])
                h = s(a[2 * u : 3 * u]) * np.tanh(c)
                states[k, t] = h
        logits = [float(np.concatenate((states["f", t], states["b", t], x[t])) @ p["v"] + p["c"][0]) for t in range(len(x))]
        assert all((z > 0) == g for z, g in zip(logits, got) if abs(z) > 1e-3)


def test_a_long_page_is_read_in_bounded_memory():
    import resource

    page = "".join(f'<div class="k{i} z{i * 7}">some text {i} ' for i in range(20_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = html_blocks.extract([page] + ["<p>tiny"] * 63, html_blocks.trained())
    assert len(out) == 64 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000

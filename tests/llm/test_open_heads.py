from spindrel.llm import html_blocks


def test_a_head_ends_where_the_content_starts():
    texts = lambda h: [b.text for b in html_blocks.blocks(h)]
    top = "<html><head><meta charset=utf-8><title>T</title><script>x</script><style>p{}</style>"
    assert texts(f"{top}<body><p>one<p>two</body></html>") == ["one", "two"]
    assert texts(f"{top}<p>one<p>two") == ["one", "two"]
    assert texts(f"{top}<img src=x>one <b>two</b>") == ["one two"]
    assert texts(f"{top} plain text<p>two") == ["plain text", "two"]
    assert texts(f"{top}<link rel=x></head><body><p>one</p></body>") == ["one"]

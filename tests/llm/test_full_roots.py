from spindrel.llm import merkle


def test_roots_of_many_short_texts_differ():
    roots = {merkle.Tree.of(f"text {i}").root for i in range(200_000)}
    assert len(roots) == 200_000

import numpy as np

from spindrel.llm import decontaminate


def test_passages_of_an_item_are_found_wherever_they_start():
    r = np.random.default_rng(6)
    words = ["".join(r.choice(list("abcdefghijklmnop"), r.integers(2, 8))) for _ in range(400)]
    item, text = (decontaminate.plain(" ".join(r.choice(words, n))) for n in (50, 400))
    assert len(item) > 230
    index = decontaminate.Index([(7, item)])
    for n in (90, 150, 215):
        for a in range(0, len(item) - n + 1, 7):
            assert {x[0] for x in index.find(f"{text} {item[a : a + n]} {text}")} == {7}
    assert index.find(text) == []


def test_short_items_are_found_without_an_end_or_with_one_other_word():
    item = "seven quiet travellers crossed the frozen river before dawn and told nobody why"
    assert 60 < len(item) < 100
    index = decontaminate.Index([(1, item)])
    assert index.find(item[:-12]) and index.find(item[12:])
    assert index.find(item.replace("seven", "umbrella")) and index.find(item.replace("nobody", "strangers"))


def test_edits_in_the_middle_of_a_part_stay_within_its_bound():
    item = "seven quiet travellers crossed the frozen river before dawn and told nobody about the reason they were there today"
    assert 100 <= len(item) <= 120
    index = decontaminate.Index([(1, item)])
    assert index.find(item[:54] + "zzzzz" + item[59:])

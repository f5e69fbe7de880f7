import os
import random

import pytest

from spindrel.llm import components as stars
from spindrel.llm import scratch


def folders(spark, name):
    at = os.path.join(scratch.folder(spark).removeprefix("file://").removeprefix("file:"), "spindrel")
    return {f for f in os.listdir(at) if f.startswith(name)} if os.path.isdir(at) else set()


def graph(seed=5):
    r = random.Random(seed)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(1000, 1090)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(300)] + [(7, 7), (None, 5), (3000, 2999)]
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(len(label)):
        for x, y in edges:
            if x in label and y in label and x != y:
                label[x] = label[y] = min(label[x], label[y])
    return edges, label


@pytest.mark.parametrize("local,hub", [(1 << 18, 4096), (-1, 4096), (-1, 5)])
def test_components_by_any_path(spark, monkeypatch, local, hub):
    monkeypatch.setattr(stars, "LOCAL", local)
    monkeypatch.setattr(stars, "HUB", hub)
    monkeypatch.setattr(stars, "AT_ONCE", 64)
    edges, label = graph()
    before = folders(spark, "edges")
    got = {r.node: r.comp for r in stars.components(spark.createDataFrame(edges, "x long, y long").repartition(3)).collect()}
    assert got == label
    assert len(folders(spark, "edges") - before) <= 1  # rounds that are over leave no files

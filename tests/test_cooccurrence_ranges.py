from collections import Counter, defaultdict

import numpy as np
import pytest

from spindrel.operators import topics


@pytest.mark.parametrize("small", [{}, dict(SUMMED=4, RANGE=6, WAVE=20)])
def test_rows_by_ranges_and_waves_are_whole(spark, small, monkeypatch):
    for k, x in small.items():
        monkeypatch.setattr(topics, k, x)
    r = np.random.default_rng(3)
    docs = [[f"w{int(x)}" for x in r.zipf(1.4, int(r.integers(1, 25))) % 97] for _ in range(90)]
    v, total = defaultdict(int), Counter()
    for words in docs:
        n = Counter(words)
        for i in n:
            for j in n:
                v[i, j] += n[i] * (n[j] - (i == j))
                total[i] += n[i] * (n[j] - (i == j))
    partners, squares = Counter(i for (i, _), x in v.items() if x), Counter()
    for (i, _), x in v.items():
        squares[i] += x * x
    rows = spark.createDataFrame([(d, p, w) for d, words in enumerate(docs) for p, w in enumerate(words)], "doc_id long, pos long, term string")
    got = {x.term: (x.partners, x.total, x.norm) for x in topics.cooccurrence_rows(rows).collect()}
    assert got == {i: (partners[i], total[i], pytest.approx(squares[i] ** 0.5 / total[i]) if total[i] else None) for i in total}


def test_pairs_of_a_task_are_bounded():
    import pyarrow as pa

    ids, ns = np.arange(300), np.ones(300, np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array([ids.tolist()] * 20), pa.array([ns.tolist()] * 20)], ["ids", "ns"])
    with pytest.MonkeyPatch.context() as m:
        m.setattr(topics, "SUMMED", 5000)
        sizes = [len(x.as_buffer()) // 8 for b in topics._range_pairs([batch], [100, 150, 200]) for x in b.column(1)]
    assert max(sizes) <= 10000 and len(sizes) > 20

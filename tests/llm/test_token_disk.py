import re
import time

import numpy as np
import pytest

from spindrel.llm import elias_fano
from test_tokens import ODD, whole

ROWS = [(i * 7 % 60, f"{ODD[i % len(ODD)] or ''} {i}") for i in range(60)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {n for n in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n}


def test_texts_leave_no_shuffle_files(spark, docs, tmp_path):
    docs.count()
    before = shuffle_files(spark)
    elias_fano.write_tokens(docs, str(tmp_path / "tokens"), elias_fano.default_path(), 2)
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left


def test_segments_are_read_where_they_lie(spark, docs):
    key = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(key)
    spark.conf.set(key, "1")  # segments of a large table are beyond it, and so is what Spark takes their sums to be
    try:
        out = elias_fano.token_files(docs, end=2)
        got = sorted(out.collect(), key=lambda r: r.start)
        plan = out._jdf.queryExecution().explainString(out.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set(key, kept)
    assert [r.doc_id for r in got] == list(range(60))
    at = 0
    for r, (_, text) in zip(got, sorted(ROWS)):
        assert (r.start, np.frombuffer(r.ids, np.uint32).tolist()) == (at, whole(text) + [2])
        at += r.n_tokens
    inputs = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (.*)", plan)
    assert inputs and not [x for x in inputs if "segment#" in x]

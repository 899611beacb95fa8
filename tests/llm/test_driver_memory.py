"""Work that is kept off the driver: its memory holds plans."""

import os

import numpy as np
from pyspark.sql import functions as F

from grainfield.llm import common, toxicity


def test_small_edge_tables_take_one_step(spark, monkeypatch):
    written = []
    cut = common.cut
    monkeypatch.setattr(common, "cut", lambda df: written.append(1) or cut(df))
    e = spark.range(500).select((F.col("id") * 7 % 501).alias("a"), ((F.col("id") * 7 + 7) % 501).alias("b"))
    got = common.components(e).collect()
    assert len(got) == 501 and {r.component for r in got} == {0} and len(written) == 1


def test_shuffled_components_equal_those_of_one_task(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pairs = [tuple(map(int, p)) for p in rng.integers(-40, 40, (45, 2))]
    e = spark.createDataFrame([*pairs, (None, 3), (99, None)], "a long, b long")
    want = {i: i for i in range(-40, 40)}
    for _ in want:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    want = {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in pairs)}
    assert dict(map(tuple, common.components(e).collect())) == want
    monkeypatch.setattr(common, "SMALL_EDGES", 0)
    assert dict(map(tuple, common.components(e).collect())) == want


def test_the_driver_does_not_train(spark, monkeypatch):
    driver, train = os.getpid(), toxicity.train

    def watched(*args, **kwargs):
        assert os.getpid() != driver, "trained on the driver"
        return train(*args, **kwargs)

    monkeypatch.setattr(toxicity, "train", watched)
    docs = spark.createDataFrame([(i, "foul word" if i % 2 else "fine day") for i in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    got = toxicity.toxicity(docs, labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)

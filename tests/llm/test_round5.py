"""Searches whose queries lie elsewhere than the rows, or near few of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann


def recalls(spark, x, every, k=20, recall=0.97):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = {}
    for r in ann.search(frame, F.col("vec_id") % every == 0, k, recall).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    out = []
    for q in range(0, len(x), every):
        s = x @ x[q]
        s[q] = -np.inf
        out.append(len(found[q] & set(np.argsort(-s, kind="stable")[:k].tolist())) / k)
    return np.array(out)


@pytest.mark.parametrize("kind", ["queries elsewhere", "small clusters", "long tails"])
def test_recall_of_each_query(spark, kind):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(8000, 32))
    if kind == "queries elsewhere":
        x[:, :16] *= 0.05
        x[::20] = rng.normal(size=(400, 32)) * np.repeat([1, 0.05], 16)
    elif kind == "small clusters":
        x = rng.normal(size=(200, 32))[rng.integers(200, size=8000)] + 0.001 * x
    else:
        x = rng.standard_t(1.5, size=(8000, 32))
    got = recalls(spark, x, 20)
    assert got.mean() >= 0.97 and got.min() >= 0.7

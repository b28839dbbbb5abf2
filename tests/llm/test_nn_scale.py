"""Recall of NN-descent whatever the sizes of the vectors (operator 5)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkscout.llm import nndescent


def _recall(spark, x, kind, k=10):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = nndescent.nearest(df, F.col("id") % 20 == 0, k=k, graph_k=16, width=32).toPandas()
    hits = []
    for q in range(0, len(x), 20):
        own = got[got.query_id == q].sort_values("rank")
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert len(own) == k
        hits.append(len(set(own.vec_id) & set(np.argsort(d)[:k])) / k)
    return np.mean(hits)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_one_huge_vector_and_a_tight_cluster(spark, kind):
    rng = np.random.default_rng(4)
    x = 0.1 * rng.normal(size=(1500, 8))
    x[::3] = x[0] + 1e-5 * rng.normal(size=(500, 8))
    x[7] = 1e8
    x = x.astype(np.float32 if kind == "float" else np.float64).astype(np.float64)
    assert _recall(spark, x, kind) >= 0.9


def test_squares_hold_what_products_lose():
    rng = np.random.default_rng(2)
    y = rng.normal(size=(3, 40, 8))
    y[0, :5] = 1e8 + 0.1 * rng.normal(size=(5, 8))
    y[1, :20] = 1 + 1e-9 * rng.normal(size=(20, 8))
    y[2, 0] = 1e300
    with np.errstate(over="ignore"):
        want = ((y[:, :, None] - y[:, None]) ** 2).sum(axis=3)
    assert np.allclose(nndescent._squares(y), np.minimum(want, np.finfo(float).max), rtol=1e-6, atol=0)

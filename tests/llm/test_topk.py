"""Norm-bucketed search against brute force with Python integers."""

import math

import numpy as np
from pyspark.sql import functions as F

from annospark.llm import topk


def brute(rows, k):
    vecs = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(1024 * x) for x in v)]
    out = set()
    for qi, q in {(i, tuple(v)) for i, v in vecs if i % 100 == 0}:
        scored = sorted((-max(topk.LOWEST, min(topk.HIGHEST, sum(a * b for a, b in zip(q, v)))), i)
                        for i, v in vecs if i != qi and len(v) == len(q))
        out |= {(qi, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def found(spark, rows, kind="double", k=10):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("score", F.lit("clash")).withColumn("dims", F.lit(1))
    return [tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 100 == 0, k=k).collect()]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 100)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(2)
    near = rng.normal(size=(20, 16))
    rows = [(i, (near[i % 20] + rng.normal(size=16) * 0.1 * (i % 7)).tolist()) for i in range(900)]
    rows += [(1000 + i, (rng.normal(size=16) * 2.0 ** (i % 9 - 4)).tolist()) for i in range(300)]
    rows += [(2000 + i, [0.5] * 16) for i in range(150)]                      # one very common vector: ties
    rows += [(3000, None), (3001, [None] * 16), (3100, [float("nan")] * 16), (3002, [float("inf")] * 16), (None, [1.0] * 16),
             (3200, [0.0] * 16), (3300, [1.0, 2.0]), (3301, [2.0, 2.0]), (3400, []), (3401, [])]
    got = found(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows, 10)


def test_huge_components_fall_back_to_integers(spark):
    rows = [(0, [1e17, -3.0]), (1, [1e17, 5.0]), (2, [1.0, 1.0]), (3, [-1e300, 0.0]), (100, [7e12, 1.0]), (4, [3e9, 1e-3])]
    assert set(found(spark, rows)) == brute(rows, 10)


def test_empty_and_fewer_than_k(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 1024 * 2048)]


def test_pruning_keeps_all_that_reach(spark):
    rng = np.random.default_rng(4)
    x = np.floor(1024 * rng.normal(size=(2000, 32)))
    norms = np.linalg.norm(x, axis=1)
    for scale in (1.0, 6.0):
        q = np.floor(scale * x[7])
        scores = x @ q
        for least in np.sort(scores)[[-2, -10, -200]]:
            keep = topk.survivors(x, norms, q, float(np.linalg.norm(q)), float(least))
            assert set(np.flatnonzero(scores >= least)) <= set(keep) and len(keep) <= len(x)

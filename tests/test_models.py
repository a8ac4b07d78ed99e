"""Conditional logit and cluster-robust logit against brute-force numpy fits."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from annospark.operators import models as MD


def _synthetic(seed=0, n_blocks=300):
    rng = np.random.default_rng(seed)
    rows = []
    for b in range(n_blocks):
        u = rng.normal()
        doc = f"d{b % 12}"
        year = 1840 + (b % 12) * 7
        for m in ["M1", "M2"]:
            for p in ["A", "B", "C"]:
                eta = u + 0.4 * (m == "M2") + 0.6 * (p == "B") - 0.3 * (p == "C") + 0.5 * (m == "M2" and p == "C")
                rows.append((b, doc, year, m, p, int(rng.random() < 1 / (1 + math.exp(-eta)))))
    return rows


def _bruteforce_clogit_ll(rows, beta, design):
    by = {}
    for b, _, _, m, p, y in rows:
        by.setdefault(b, []).append((design[f"{m}@{p}"], y))
    ll = 0.0
    for items in by.values():
        k = sum(y for _, y in items)
        if k == 0 or k == len(items):
            continue
        num = sum(x @ beta for x, y in items if y == 1)
        den = sum(math.exp(sum(items[i][0] @ beta for i in c)) for c in itertools.combinations(range(len(items)), k))
        ll += num - math.log(den)
    return ll


def test_clogit_matches_bruteforce_likelihood(spark):
    rows = _synthetic()
    df = spark.createDataFrame(rows, "block_id long, doc_id string, year int, model string, prompt string, correct int")
    data = MD.clogit_data(df, F.concat_ws("@", "model", "prompt"))
    design = {}
    for m in ["M1", "M2"]:
        for p in ["A", "B", "C"]:
            design[f"{m}@{p}"] = np.array([m == "M2", p == "B", p == "C", m == "M2" and p == "B", m == "M2" and p == "C"], float)
    fit = MD.fit_clogit(data, design)
    assert fit["llf"] == pytest.approx(_bruteforce_clogit_ll(rows, fit["params"], design), abs=1e-8)
    # optimum: brute-force likelihood is lower at perturbed points
    for j in range(5):
        d = np.zeros(5); d[j] = 1e-3
        assert _bruteforce_clogit_ll(rows, fit["params"] + d, design) <= fit["llf"] + 1e-9
        assert _bruteforce_clogit_ll(rows, fit["params"] - d, design) <= fit["llf"] + 1e-9


def test_logit_cluster_matches_numpy(spark):
    rows = _synthetic(seed=1, n_blocks=400)
    df = spark.createDataFrame(rows, "block_id long, doc_id string, year int, model string, prompt string, correct int")
    got = MD.logit_cluster(spark, df, "correct", "model", "prompt", "year", "doc_id")
    X, y, g = [], [], []
    for _, doc, year, m, p, c in rows:
        X.append([1, m == "M2", p == "B", p == "C", m == "M2" and p == "B", m == "M2" and p == "C", year - 1880.0])
        y.append(c); g.append(doc)
    X, y = np.array(X, float), np.array(y, float)
    beta = np.zeros(X.shape[1])
    for _ in range(50):
        pr = 1 / (1 + np.exp(-X @ beta))
        H = X.T @ (X * (pr * (1 - pr))[:, None])
        step = np.linalg.solve(H, X.T @ (y - pr))
        beta += step
        if np.abs(step).max() < 1e-12:
            break
    pr = 1 / (1 + np.exp(-X @ beta))
    H = X.T @ (X * (pr * (1 - pr))[:, None])
    S = X * (y - pr)[:, None]
    groups = sorted(set(g))
    M = sum(np.outer(S[np.array(g) == k].sum(0), S[np.array(g) == k].sum(0)) for k in groups)
    n, kp, G = len(y), X.shape[1], len(groups)
    V = np.linalg.inv(H) @ M @ np.linalg.inv(H) * G / (G - 1) * (n - 1) / (n - kp)
    assert got["beta"] == pytest.approx(beta[-1], abs=1e-9)
    assert got["se"] == pytest.approx(math.sqrt(V[-1, -1]), rel=1e-6)


def test_single_pass_lr_tests_equal_per_subset_fits(spark):
    from paths import SF0001
    from annospark.operators.reshape import long_fact
    from annospark.plans import fixtures as fx
    lf = long_fact(fx.annotations_wide(spark, SF0001)).cache()
    got = MD.clogit_lr_tests(lf)
    ref = [MD.lr_interaction(lf, "model", "prompt"),
           MD.lr_interaction(lf.where("gold = 1"), "model", "prompt"),
           MD.lr_interaction(lf.where("gold = 0"), "model", "prompt"),
           MD.lr_interaction(lf.where("prompt = 'C' AND gold = 1"), "model", "period", absorbed_b=True),
           MD.lr_interaction(lf.where("prompt = 'C' AND gold = 0"), "model", "period", absorbed_b=True)]
    for g, r in zip(got, ref):
        assert g[2] == pytest.approx(r[0], abs=1e-6) and g[3] == r[1]


def test_joint_block_diagonal_logit_equals_separate_fits(spark):
    rows = [r + (r[0] % 2,) for r in _synthetic(seed=2, n_blocks=300)]
    df = spark.createDataFrame(rows, "block_id long, doc_id string, year int, model string, prompt string, "
                                     "correct int, cls int")
    joint = MD.logit_cluster_by(spark, df, "correct", "model", "prompt", "year", "doc_id", "cls", [0, 1])
    for lv in (0, 1):
        sep = MD.logit_cluster(spark, df.where(F.col("cls") == lv), "correct", "model", "prompt", "year", "doc_id")
        assert joint[lv]["beta"] == pytest.approx(sep["beta"], abs=1e-10)
        assert joint[lv]["se"] == pytest.approx(sep["se"], rel=1e-8)

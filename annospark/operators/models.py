"""Regression models fitted from Spark-computed sufficient statistics.

* Conditional (fixed-effect) logit grouped by block: Spark reduces the data
  to (signature, k, n_blocks) patterns and per-condition success sums; the
  likelihood depends on nothing else, so the driver solves <= ~16
  parameters whatever the data size.
* Logit with cluster-robust errors: IRLS where every Newton step is one
  Spark aggregate (gradient + Hessian) over a checkpointed collapsed table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annospark.functions.stats import chi2_sf, norm_sf
from annospark.operators.inference import block_signatures
from annospark.session import checkpoint_dir

Z975 = 1.959963984540054


# ---------------------------------------------------------------- design helpers
def dummy_levels(levels: list[str]) -> list[str]:
    """Treatment coding: alphabetical first level is the baseline."""
    return sorted(levels)[1:]


@dataclass
class ClogitData:
    groups: list[tuple[list[str], int, int]]   # (conditions of the block, k, n_blocks)
    successes: dict[str, float]                 # condition -> sum(correct) over informative blocks


def clogit_data(rows: DataFrame, cond: F.Column) -> ClogitData:
    """Collect only sufficient statistics: one row per (signature, k) and per condition."""
    sig = block_signatures(rows, cond).cache()
    pats = sig.groupBy("sig", "k").agg(F.count(F.lit(1)).alias("n")).collect()
    succ = (sig.select(F.explode("succ").alias("cond")).groupBy("cond")
            .agg(F.count(F.lit(1)).alias("s")).collect())
    sig.unpersist()
    return ClogitData([(r["sig"].split(","), int(r["k"]), int(r["n"])) for r in pats],
                      {r["cond"]: float(r["s"]) for r in succ})


def _esp_stats(W: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For G groups of m weights (G, m) and sizes k (G,): e_k(w) and inclusion
    probabilities pi_i = w_i e_{k-1}(w without i) / e_k(w), vectorised over groups.

    Uses prefix and suffix elementary symmetric polynomials (no subtraction,
    hence numerically stable).
    """
    G, m = W.shape
    pre = np.zeros((m + 1, G, m + 1))
    pre[0][:, 0] = 1.0
    for i in range(m):
        pre[i + 1] = pre[i]
        pre[i + 1][:, 1:] += W[:, i:i + 1] * pre[i][:, :-1]
    suf = np.zeros((m + 1, G, m + 1))
    suf[m][:, 0] = 1.0
    for i in range(m - 1, -1, -1):
        suf[i] = suf[i + 1]
        suf[i][:, 1:] += W[:, i:i + 1] * suf[i + 1][:, :-1]
    rows = np.arange(G)
    ek = pre[m][rows, k]
    pis = np.empty((G, m))
    km1 = k - 1
    for i in range(m):
        # e_{k-1}(w_-i) = sum_t pre_i[t] * suf_{i+1}[k-1-t]
        acc = np.zeros(G)
        for t in range(m):
            idx = km1 - t
            ok = idx >= 0
            acc += np.where(ok, pre[i][:, t] * suf[i + 1][rows, np.clip(idx, 0, m)], 0.0)
        pis[:, i] = W[:, i] * acc / ek
    return ek, pis


def fit_clogit(data: ClogitData, design: dict[str, np.ndarray], max_iter: int = 100,
               beta0: np.ndarray | None = None) -> dict:
    """Newton-Raphson on the conditional log-likelihood; returns params, cov, llf.

    Groups with the same number of observations are evaluated together as
    arrays (G, m, p); the driver work is independent of the number of blocks.
    """
    p = len(next(iter(design.values())))
    T = np.zeros(p)
    for c, s in data.successes.items():
        T += s * design[c]
    by_m: dict[int, list] = {}
    for conds, k, n in data.groups:
        by_m.setdefault(len(conds), []).append((np.array([design[c] for c in conds]), k, n))
    packs = [(np.stack([g[0] for g in gs]), np.array([g[1] for g in gs]), np.array([g[2] for g in gs], float))
             for gs in by_m.values()]

    def ll_grad(beta):
        ll, g = float(beta @ T), T.copy()
        for X, k, n in packs:
            eta = X @ beta                                  # (G, m)
            shift = eta.max(axis=1, keepdims=True)
            ek, pis = _esp_stats(np.exp(eta - shift), k)
            ll -= float(n @ (np.log(ek) + k * shift[:, 0]))
            g -= np.einsum("g,gi,gip->p", n, pis, X)
        return ll, g

    def hessian(beta, g0=None, eps=1e-6):
        """Numerical Jacobian of the analytic gradient: forward differences
        while iterating (g0 given), central differences for the final covariance."""
        H = np.zeros((p, p))
        for j in range(p):
            d = np.zeros(p)
            d[j] = eps
            if g0 is None:
                H[:, j] = (ll_grad(beta + d)[1] - ll_grad(beta - d)[1]) / (2 * eps)
            else:
                H[:, j] = (ll_grad(beta + d)[1] - g0) / eps
        return (H + H.T) / 2

    beta = np.zeros(p) if beta0 is None else np.asarray(beta0, dtype=float).copy()
    ll, g = ll_grad(beta)
    for _ in range(max_iter):
        H = hessian(beta, g)
        step = np.linalg.solve(H, -g)
        t = 1.0
        while True:
            nb = beta + t * step
            nll, ng = ll_grad(nb)
            if nll >= ll - 1e-12 or t < 1e-8:
                break
            t /= 2
        done = np.max(np.abs(nb - beta)) < 1e-10 or abs(nll - ll) < 1e-13
        beta, ll, g = nb, nll, ng
        if done:
            break
    cov = np.linalg.inv(-hessian(beta))
    return {"params": beta, "cov": cov, "llf": ll}


def _designs(seen: set[str], absorbed_b: bool) -> tuple[dict, dict, int]:
    """Main-effect and interaction designs for conditions 'a@b' (treatment coding)."""
    la = sorted({c.split("@")[0] for c in seen})
    lb = sorted({c.split("@")[1] for c in seen})
    da, db = dummy_levels(la), dummy_levels(lb)
    d0, d1 = {}, {}
    for a in la:
        for b in lb:
            xa = [1.0 if a == x else 0.0 for x in da]
            xb = [] if absorbed_b else [1.0 if b == y else 0.0 for y in db]
            xi = [(1.0 if a == x else 0.0) * (1.0 if b == y else 0.0) for x in da for y in db]
            d0[f"{a}@{b}"] = np.array(xa + xb)
            d1[f"{a}@{b}"] = np.array(xa + xb + xi)
    return d0, d1, len(da) * len(db)


def _lr_from_data(data: ClogitData, absorbed_b: bool) -> tuple[float, int, float]:
    seen = {c for conds, _, _ in data.groups for c in conds}       # levels from the statistics
    d0, d1, df = _designs(seen, absorbed_b)
    m0 = fit_clogit(data, d0)
    # the interaction design extends the main-effect design: warm start from its solution
    start = np.concatenate([m0["params"], np.zeros(len(next(iter(d1.values()))) - len(m0["params"]))])
    m1 = fit_clogit(data, d1, beta0=start)
    lr = 2 * (m1["llf"] - m0["llf"])
    return float(lr), int(df), float(chi2_sf(lr, df))


def lr_interaction(rows: DataFrame, a_col: str, b_col: str, absorbed_b: bool = False) -> tuple[float, int, float]:
    """LR test of the a x b interaction in a conditional logit grouped by block.

    When `absorbed_b` the b main effect is constant within blocks (e.g. the
    period of a block) and is left out of both models.
    """
    return _lr_from_data(clogit_data(rows, F.concat_ws("@", F.col(a_col), F.col(b_col))), absorbed_b)


def _data_from_blocks(b: DataFrame, k: str, m: str, sig: str, succ: str) -> ClogitData:
    inf = b.where((F.col(k) > 0) & (F.col(k) < F.col(m)))
    pats = inf.groupBy(sig, k).agg(F.count(F.lit(1)).alias("n")).collect()
    sc = inf.select(F.explode(succ).alias("cond")).groupBy("cond").agg(F.count(F.lit(1)).alias("s")).collect()
    return ClogitData([(r[sig].split(","), int(r[k]), int(r["n"])) for r in pats],
                      {r["cond"]: float(r["s"]) for r in sc})


def clogit_lr_tests(lf: DataFrame) -> list[tuple]:
    """The five interaction tests: model x prompt (all / positives / negatives) and
    model x period at prompt C (positives / negatives).

    One group-by over the long fact yields, per block, both signatures (all
    conditions; prompt-C models with the block's period), their success
    lists and the block's gold class; the five tests then only filter that
    block table (lists bounded by the number of conditions).
    """
    mp = F.concat_ws("@", "model", "prompt")
    mper = F.concat_ws("@", "model", "period")
    is_c = F.col("prompt") == "C"
    ok = F.col("correct") == 1
    b = lf.groupBy("block_id").agg(
        F.max("gold").alias("gold"),
        F.sum("correct").alias("k_all"), F.count(F.lit(1)).alias("m_all"),
        F.array_join(F.sort_array(F.collect_list(mp)), ",").alias("sig_all"),
        F.collect_list(F.when(ok, mp)).alias("succ_all"),
        F.sum(F.when(is_c, F.col("correct")).otherwise(0)).alias("k_c"), F.count_if(is_c).alias("m_c"),
        F.array_join(F.sort_array(F.collect_list(F.when(is_c, mper))), ",").alias("sig_c"),
        F.collect_list(F.when(is_c & ok, mper)).alias("succ_c")).cache()
    out = []
    for lab, cond in [("tutti", F.lit(True)), ("positivi", F.col("gold") == 1), ("negativi", F.col("gold") == 0)]:
        data = _data_from_blocks(b.where(cond), "k_all", "m_all", "sig_all", "succ_all")
        out.append(("modello x prompt", lab, *_lr_from_data(data, absorbed_b=False)))
    for lab, g in [("positivi", 1), ("negativi", 0)]:
        data = _data_from_blocks(b.where(F.col("gold") == g), "k_c", "m_c", "sig_c", "succ_c")
        out.append(("modello x periodo (prompt C)", lab, *_lr_from_data(data, absorbed_b=True)))
    b.unpersist()
    return out


def odds_ratios(lf: DataFrame, models: list[str]) -> list[tuple]:
    """Per model: odds ratio of B and C vs A with Wald 95 % CI and p (conditional logit by block),
    plus the number of informative blocks.

    One group-by over (model, block) yields every model's block signatures;
    each model's fit then reads only its slice of that table.
    """
    b = lf.groupBy("model", "block_id").agg(
        F.sum("correct").alias("k"), F.count(F.lit(1)).alias("m"),
        F.array_join(F.sort_array(F.collect_list("prompt")), ",").alias("sig"),
        F.collect_list(F.when(F.col("correct") == 1, F.col("prompt"))).alias("succ")).cache()
    informative = {r["model"]: int(r["n"]) for r in
                   b.where((F.col("k") > 0) & (F.col("k") < F.col("m"))).groupBy("model")
                   .agg(F.count(F.lit(1)).alias("n")).collect()}
    design = {"A": np.array([0.0, 0.0]), "B": np.array([1.0, 0.0]), "C": np.array([0.0, 1.0])}
    out = []
    for mdl in models:
        data = _data_from_blocks(b.where(F.col("model") == mdl), "k", "m", "sig", "succ")
        fit = fit_clogit(data, design)
        for j, p in enumerate(["B", "C"]):
            beta, se = fit["params"][j], math.sqrt(fit["cov"][j, j])
            out.append((mdl, f"{p} vs A", float(math.exp(beta)), float(math.exp(beta - Z975 * se)),
                        float(math.exp(beta + Z975 * se)), float(2 * norm_sf(abs(beta / se))),
                        informative.get(mdl, 0)))
    b.unpersist()
    return out


# ---------------------------------------------------------------- cluster-robust logit
def _irls_partials(x: DataFrame, xcols: list[str], beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the binomial log-likelihood at beta.

    Each task reduces its rows with numpy to k + k*k partial sums (beta is
    closed over, so no per-iteration code generation); Spark sums the
    partials with one small group-by; only those k + k*k numbers reach the
    driver.
    """
    import pandas as pd
    k = len(xcols)
    b = beta.copy()

    def partial(batches):
        g = np.zeros(k)
        H = np.zeros((k, k))
        for pdf in batches:
            X = pdf[xcols].to_numpy(dtype=float)
            n, y = pdf["__n"].to_numpy(dtype=float), pdf["__y"].to_numpy(dtype=float)
            p = 1.0 / (1.0 + np.exp(-(X @ b)))
            g += X.T @ (y - n * p)
            H += X.T @ (X * (n * p * (1.0 - p))[:, None])
        yield pd.DataFrame({"i": np.arange(k + k * k), "v": np.concatenate([g, H.ravel()])})

    rows = (x.select(*xcols, "__n", "__y").mapInPandas(partial, "i long, v double")
            .groupBy("i").agg(F.sum("v").alias("v")).collect())
    vec = np.zeros(k + k * k)
    for r in rows:
        vec[r["i"]] = r["v"]
    return vec[:k], vec[k:].reshape(k, k)



def _cluster_meat(x: DataFrame, xcols: list[str], beta: np.ndarray, cluster: str) -> np.ndarray:
    """Sum over clusters of s_g s_g^T, s_g = sum of x (y - n p) over the cluster's rows.

    Row scores are computed in tasks (numpy), summed per cluster by a Spark
    group-by, and the outer products are reduced per task to k*k partials.
    """
    import pandas as pd
    k = len(xcols)
    b = beta.copy()
    scols = [f"s{j}" for j in range(k)]

    def row_scores(batches):
        for pdf in batches:
            X = pdf[xcols].to_numpy(dtype=float)
            n, y = pdf["__n"].to_numpy(dtype=float), pdf["__y"].to_numpy(dtype=float)
            r = y - n / (1.0 + np.exp(-(X @ b)))
            out = pd.DataFrame(X * r[:, None], columns=scols)
            out.insert(0, "__c", pdf["__c"].astype(str).to_numpy())
            yield out

    def outer(batches):
        M = np.zeros((k, k))
        for pdf in batches:
            S = pdf[scols].to_numpy(dtype=float)
            M += S.T @ S
        yield pd.DataFrame({"i": np.arange(k * k), "v": M.ravel()})

    schema = "__c string, " + ", ".join(f"{c} double" for c in scols)
    per = (x.select(F.col(cluster).cast("string").alias("__c"), *xcols, "__n", "__y")
           .mapInPandas(row_scores, schema)
           .groupBy("__c").agg(*[F.sum(c).alias(c) for c in scols]))
    rows = per.mapInPandas(outer, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    vec = np.zeros(k * k)
    for r in rows:
        vec[r["i"]] = r["v"]
    return vec.reshape(k, k)


def logit_cluster(spark: SparkSession, rows: DataFrame, y: str, model_col: str, prompt_col: str,
                  year_col: str, cluster: str, max_iter: int = 50) -> dict:
    """Logit  y ~ C(model) * C(prompt) + year  with cluster-robust (sandwich) errors.

    Rows are first collapsed to binomial counts per (model, prompt, year,
    cluster) and checkpointed; each IRLS step is then ONE Spark aggregate.
    """
    checkpoint_dir(spark)
    coll = (rows.groupBy(model_col, prompt_col, year_col, cluster)
            .agg(F.count(F.lit(1)).cast("double").alias("__n"), F.sum(y).cast("double").alias("__y"))
            .checkpoint(eager=True))                       # conditions x clusters x years rows
    meta = coll.agg(F.collect_set(model_col).alias("m"), F.collect_set(prompt_col).alias("p"),
                    F.sum("__n").alias("N"), F.countDistinct(cluster).alias("G")).first()
    dm, dp = dummy_levels(sorted(meta["m"])), dummy_levels(sorted(meta["p"]))
    cols = [F.lit(1.0)]
    cols += [F.when(F.col(model_col) == m, 1.0).otherwise(0.0) for m in dm]
    cols += [F.when(F.col(prompt_col) == p, 1.0).otherwise(0.0) for p in dp]
    cols += [F.when((F.col(model_col) == m) & (F.col(prompt_col) == p), 1.0).otherwise(0.0) for m in dm for p in dp]
    cols += [F.col(year_col).cast("double") - 1880.0]        # centred: same slope and SE
    k = len(cols)
    x = coll.select(cluster, "__n", "__y", *[c.alias(f"x{j}") for j, c in enumerate(cols)])
    xcols = [f"x{j}" for j in range(k)]
    beta = np.zeros(k)
    for _ in range(max_iter):
        g, H = _irls_partials(x, xcols, beta)
        step = np.linalg.solve(H, g)
        beta = beta + step
        if np.max(np.abs(step)) < 1e-10:
            break
    _, H = _irls_partials(x, xcols, beta)                      # bread at the solution
    M = _cluster_meat(x, xcols, beta, cluster)
    n_obs, n_groups = float(meta["N"]), float(meta["G"])
    Hinv = np.linalg.inv(H)
    corr = n_groups / (n_groups - 1) * (n_obs - 1) / (n_obs - k)
    V = Hinv @ M @ Hinv * corr
    b, se = beta[-1], math.sqrt(V[-1, -1])
    return {"beta": float(b), "se": float(se), "p": float(2 * norm_sf(abs(b / se)))}


def logit_cluster_by(spark: SparkSession, rows: DataFrame, y: str, model_col: str, prompt_col: str,
                     year_col: str, cluster: str, by_col: str, levels: list, max_iter: int = 50) -> dict:
    """`logit_cluster` for several independent subsets (e.g. gold classes) in one set of passes.

    The design is block-diagonal (one copy of the columns per subset), so the
    joint IRLS solves each subset's model exactly; the sandwich is taken per
    diagonal block with that subset's own small-sample correction.  Returns
    {level: {"beta", "se", "p"}} for the year coefficient.
    """
    checkpoint_dir(spark)
    coll = (rows.groupBy(by_col, model_col, prompt_col, year_col, cluster)
            .agg(F.count(F.lit(1)).cast("double").alias("__n"), F.sum(y).cast("double").alias("__y"))
            .checkpoint(eager=True))
    meta_rows = coll.groupBy(by_col).agg(
        F.collect_set(model_col).alias("m"), F.collect_set(prompt_col).alias("p"),
        F.sum("__n").alias("N"), F.countDistinct(cluster).alias("G")).collect()
    meta = {r[by_col]: r for r in meta_rows}
    dm = dummy_levels(sorted({x for r in meta_rows for x in r["m"]}))
    dp = dummy_levels(sorted({x for r in meta_rows for x in r["p"]}))
    base = [F.lit(1.0)]
    base += [F.when(F.col(model_col) == m, 1.0).otherwise(0.0) for m in dm]
    base += [F.when(F.col(prompt_col) == p, 1.0).otherwise(0.0) for p in dp]
    base += [F.when((F.col(model_col) == m) & (F.col(prompt_col) == p), 1.0).otherwise(0.0) for m in dm for p in dp]
    base += [F.col(year_col).cast("double") - 1880.0]
    kb = len(base)
    cols = [F.when(F.col(by_col) == lv, c).otherwise(0.0) for lv in levels for c in base]
    k = len(cols)
    x = coll.select(cluster, "__n", "__y", *[c.alias(f"x{j}") for j, c in enumerate(cols)])
    xcols = [f"x{j}" for j in range(k)]
    beta = np.zeros(k)
    for _ in range(max_iter):
        g, H = _irls_partials(x, xcols, beta)
        step = np.linalg.solve(H, g)
        beta = beta + step
        if np.max(np.abs(step)) < 1e-10:
            break
    _, H = _irls_partials(x, xcols, beta)
    M = _cluster_meat(x, xcols, beta, cluster)
    out = {}
    for i, lv in enumerate(levels):
        sl = slice(i * kb, (i + 1) * kb)
        Hinv = np.linalg.inv(H[sl, sl])
        n_obs, n_groups = float(meta[lv]["N"]), float(meta[lv]["G"])
        corr = n_groups / (n_groups - 1) * (n_obs - 1) / (n_obs - kb)
        V = Hinv @ M[sl, sl] @ Hinv * corr
        b, se = beta[sl][-1], math.sqrt(V[-1, -1])
        out[lv] = {"beta": float(b), "se": float(se), "p": float(2 * norm_sf(abs(b / se)))}
    return out

"""Metric formulas against the study's published numbers (recomputed from counts)."""

import pytest
from pyspark.sql import functions as F

from annospark.operators import metrics as M
from annospark.operators.reshape import pivot_long, long_fact, to_long

# (model_key, prompt, TP, FP, FN, TN) -> (accuracy, precision, recall, f1, specificity, kappa) published
GOLDEN = [
    ("claude_sonnet46", "A", 317, 85, 183, 415, (0.732, 0.7886, 0.634, 0.7029, 0.83, 0.464)),
    ("claude_sonnet46", "C", 393, 108, 107, 392, (0.785, 0.7844, 0.786, 0.7852, 0.784, 0.57)),
    ("gemini35flash", "B", 313, 50, 187, 450, (0.763, 0.8623, 0.626, 0.7254, 0.9, 0.526)),
    ("gpt_oss_120b", "B", 133, 36, 364, 461, (0.5976, 0.787, 0.2676, 0.3994, 0.9276, 0.1952)),
    ("qwen3_35b", "C", 376, 125, 124, 375, (0.751, 0.7505, 0.752, 0.7512, 0.75, 0.502)),
]


def _wide_from_counts(spark, key, prompt, tp, fp, fn, tn, n_error=0):
    rows = ([("yes", "yes")] * tp + [("no", "yes")] * fp + [("yes", "no")] * fn + [("no", "no")] * tn
            + [("yes", "error")] * n_error)
    data = [(i, g, p, "high") for i, (g, p) in enumerate(rows)]
    return spark.createDataFrame(data, f"block_id long, DIL string, DIL_{key}_prompt{prompt} string, "
                                       f"confidence_{key}_prompt{prompt} string")


@pytest.mark.parametrize("key,prompt,tp,fp,fn,tn,expected", GOLDEN)
def test_published_metrics(spark, key, prompt, tp, fp, fn, tn, expected):
    r = M.metrics_summary(_wide_from_counts(spark, key, prompt, tp, fp, fn, tn, n_error=6)).first()
    got = (r["accuracy"], r["precision"], r["recall"], r["f1"], r["specificity"], r["kappa"])
    assert got == pytest.approx(expected, abs=1e-4)
    assert r["TP"] + r["FP"] + r["FN"] + r["TN"] == r["n_valid"]
    assert r["n_error"] == 6 and r["prompt"] == f"Prompt {prompt}"


def test_zero_division_rules(spark):
    r = M.metrics_summary(_wide_from_counts(spark, "x", "A", 0, 0, 5, 0)).first()
    assert r["precision"] == 0.0 and r["f1"] == 0.0 and r["specificity"] is None
    s = M.metrics_strict(_wide_from_counts(spark, "x", "A", 0, 0, 5, 0)).first()
    assert s["specificity"] == 0.0 and s["kappa"] == 0.0


def test_kappa_symmetric_and_multiclass(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "c"), ("c", "a"), ("b", "b")],
                               "x string, y string")
    k1 = M.kappa_multiclass(df, "x", "y").first()["kappa"]
    k2 = M.kappa_multiclass(df, "y", "x").first()["kappa"]
    assert k1 == pytest.approx(k2)
    # brute force
    import collections
    rows = df.collect()
    n = len(rows)
    po = sum(r.x == r.y for r in rows) / n
    cx, cy = collections.Counter(r.x for r in rows), collections.Counter(r.y for r in rows)
    pe = sum(cx[k] * cy[k] for k in cx) / n / n
    assert k1 == pytest.approx((po - pe) / (1 - pe), abs=1e-6)


def test_pairwise_kappa_matches_pairwise_bruteforce(spark):
    from paths import SF0001
    from annospark.plans import fixtures as fx
    wide = fx.annotations_wide(spark, SF0001)
    pw = {(r["system_A"], r["system_B"]): (r["kappa"], r["n"]) for r in M.pairwise_kappa(wide).collect()}
    assert len(pw) == 105
    conds = M.detect_conditions(wide)
    pdf = wide.select(*[c for c, _, _ in conds]).toPandas()
    (c1, k1, p1), (c2, k2, p2) = conds[0], conds[5]
    a = pdf[c1].map({"yes": 1, "no": 0})
    b = pdf[c2].map({"yes": 1, "no": 0})
    ok = a.notna() & b.notna()
    a, b = a[ok].astype(int), b[ok].astype(int)
    n = len(a)
    po = (a == b).mean()
    pe = (a.mean() * b.mean()) + ((1 - a.mean()) * (1 - b.mean()))
    key = (f"{M.MODEL_LABELS[k1]} / Prompt {p1}", f"{M.MODEL_LABELS[k2]} / Prompt {p2}")
    assert pw[key][1] == n
    assert pw[key][0] == pytest.approx(round((po - pe) / (1 - pe), 4), abs=1e-4)


def test_long_then_pivot_is_identity(spark):
    from paths import SF0001
    from annospark.plans import fixtures as fx
    wide = fx.annotations_wide(spark, SF0001)
    lf = long_fact(wide, extra=["model_key"])
    conds = [f"{k}_prompt{p}" for k, p in fx.conditions()]
    piv = pivot_long(lf, ["model_key", "prompt"], conds)
    back = (to_long(wide, ["block_id"])
            .withColumn("pred", F.when(F.lower("label") == "yes", 1.0).when(F.lower("label") == "no", 0.0))
            .where(F.col("pred").isNotNull()))
    melted = piv.select("block_id", F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in conds]), F.array(*[F.col(f"`{c}`") for c in conds]))).alias("cond", "pred")) \
        .where(F.col("pred").isNotNull())
    a = sorted((r.block_id, r.cond, r.pred) for r in melted.collect())
    b = sorted((r.block_id, f"{r.model_key}_prompt{r.prompt}", r.pred) for r in back.collect())
    assert a == b


PUBLISHED_KAPPA = {  # model_key -> kappa for prompts A, B, C (published summary)
    "claude_sonnet46": (0.464, 0.536, 0.57), "gemini35flash": (0.548, 0.526, 0.556),
    "gpt55": (0.548, 0.538, 0.558), "gpt_oss_120b": (0.22, 0.1952, 0.346), "qwen3_35b": (0.43, 0.462, 0.502),
}


def test_published_ranking(spark):
    from annospark.constants import MODEL_LABELS
    rows = [(MODEL_LABELS[k], k, f"Prompt {p}", kap, 0.5, 0.5)
            for k, ks in PUBLISHED_KAPPA.items() for p, kap in zip("ABC", ks)]
    summary = spark.createDataFrame(rows, "model string, model_key string, prompt string, kappa double, f1 double, accuracy double")
    best = M.best_overall(summary).first()
    assert (best["best_model"], best["best_model_kappa"]) == ("GPT-5.5", 0.548)
    assert (best["best_prompt"], best["best_prompt_kappa"]) == ("Prompt C", 0.5064)
    per = {r["model_key"]: r["prompt"] for r in M.best_per_model(summary).collect()}
    assert per == {"claude_sonnet46": "Prompt C", "gemini35flash": "Prompt C", "gpt55": "Prompt C",
                   "gpt_oss_120b": "Prompt C", "qwen3_35b": "Prompt C"}
    ranks = [r["model_key"] for r in M.rank_models(summary).orderBy("rank").collect()]
    assert ranks == ["gpt55", "gemini35flash", "claude_sonnet46", "qwen3_35b", "gpt_oss_120b"]


def test_merge_conditions_repeated_and_null_keys(spark):
    from annospark.operators.reshape import merge_conditions
    a = spark.createDataFrame([("t", 1, "yes"), (None, 2, "no"), ("u", 3, "no")], "text string, row int, DIL_m_promptA string")
    b = spark.createDataFrame([("t", "yes"), ("t", "no"), (None, "yes"), ("v", "no")], "text string, DIL_m_promptB string")
    c = spark.createDataFrame([("u", "no")], "text string, DIL_m_promptA string")
    got = merge_conditions([a, b, c], on="text")
    assert got.columns == ["text", "row", "DIL_m_promptA", "DIL_m_promptB", "DIL_m_promptA_dup_2"]
    assert sorted(map(tuple, got.drop("text").collect()), key=str) == sorted(
        [(1, "yes", "yes", None), (1, "yes", "no", None), (2, "no", "yes", None), (3, "no", None, "no")], key=str)


def test_smoke_sample_ranks_a_smallest_work_beyond_the_first_ten(spark, tmp_path):
    from annospark.plans.q_annotate import _smoke
    docs = [(10 * w + i, f"w{w:02d}") for w in range(13) for i in range(1 if w == 12 else 2)]
    spark.createDataFrame(docs, "doc_id long, source string").selectExpr("*", "'x' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r["work"]: (r["n_blocks"], r["name_rank"], r["is_smallest"]) for r in _smoke(spark, str(tmp_path)).collect()}
    assert len(rows) == 11 and rows["w12"] == (1, 13, True) and rows["w03"] == (2, 4, False)


def test_pairs_equal_the_reports_of_each_pair(spark):
    from itertools import combinations
    from paths import SF0001
    from annospark.plans import fixtures as fx
    wide = fx.annotations_wide(spark, SF0001)
    conds = [c for c, _, _ in M.detect_conditions(wide)][:4]
    few = wide.select("block_id", "DIL", *conds, *[c.replace("DIL_", "confidence_", 1) for c in conds])
    got = {(r.system_A, r.system_B): r for r in M.compare_annotators_pairs(few).collect()}
    apart = {(r.system_A, r.system_B, r.direction): (r.n, r.v1_matches_gold, r.v2_matches_gold, r.share) for r in M.disagreements_pairs(few).collect()}
    names = [c.replace("DIL_", "confidence_", 1) for c in conds]
    kappas = {(r.system_A, r.system_B): (r.n, r.kappa) for r in M.kappa_multiclass_pairs(few, names, ["high", "medium", "low"]).collect()}
    assert len(got) == len(kappas) == 6
    for a, b in combinations(conds, 2):
        one = M.compare_annotators(few, a, b).first().asDict()
        assert one == {k: v for k, v in got[a, b].asDict().items() if k in one}
        for r in M.disagreements(few, a, b).collect():
            assert apart[a, b, r.direction] == (r.n, r.v1_matches_gold, r.v2_matches_gold, r.share)
        ca, cb = names[conds.index(a)], names[conds.index(b)]
        assert tuple(M.kappa_multiclass(few, ca, cb).first()) == kappas[ca, cb]

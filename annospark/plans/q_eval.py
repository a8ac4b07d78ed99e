"""Evaluation queries (metrics, agreement, rankings, error analysis)."""

from __future__ import annotations

from pyspark.sql import functions as F

from annospark.operators import metrics as M
from annospark.operators.reshape import long_all, long_fact, top_n_per_group
from annospark.plans import fixtures as fx
from annospark.plans.catalog import register
from annospark.plans.oracle_base import (confusion_sql, kappa_sql, rates_sql,
                                         with_base)

# ------------------------------------------------------------------ M1
register("confusion", with_base() + f"""
SELECT model_key, prompt, {confusion_sql()} FROM cl GROUP BY model_key, prompt""")(
    lambda spark, sf: M.confusion_table(fx.annotations_wide(spark, sf)))

# ------------------------------------------------------------------ M2 (flagship)
SUMMARY_SQL = with_base(f"""cm AS (
  SELECT model_key, any_value(model) AS model, prompt, {confusion_sql()} FROM cl GROUP BY model_key, prompt)""",
                        f"""summary AS (
  SELECT model, model_key, 'Prompt ' || prompt AS prompt, n_total, n_valid, n_error,
         {rates_sql(4)}, TP, FP, FN, TN FROM cm)""")

register("metrics_summary", SUMMARY_SQL + "\nSELECT * FROM summary")(
    lambda spark, sf: M.metrics_summary(fx.annotations_wide(spark, sf)))


def _summary(spark, sf):
    return M.metrics_summary(fx.annotations_wide(spark, sf))


def _wide(spark, sf):
    return fx.annotations_wide(spark, sf)


def _lf(spark, sf, extra=None):
    return long_fact(_wide(spark, sf), extra=extra)


# ------------------------------------------------------------------ M3
register("metrics_strict", with_base(f"""cs AS (
  SELECT model_key, prompt,
         CASE DIL WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS g,
         CASE label WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS p FROM ann)""",
                                     f"""cm AS (SELECT model_key, prompt, {confusion_sql()} FROM cs
  WHERE g IS NOT NULL AND p IS NOT NULL GROUP BY model_key, prompt)""") + f"""
SELECT model_key, prompt, n_valid, TP, FP, FN, TN, {rates_sql(None, '0.0', '0.0')} FROM cm""")(
    lambda spark, sf: M.metrics_strict(_wide(spark, sf)))

register("metrics_legacy", with_base(f"""cm AS (SELECT model_key, prompt, {confusion_sql()} FROM cl
  WHERE label IS NOT NULL AND DIL IS NOT NULL GROUP BY model_key, prompt)""") + f"""
SELECT model_key, prompt, n_total, n_valid, TP, FP, FN, TN,
       {rates_sql(None, '0.0', None, 'n_total', drop=('kappa',))}
FROM cm""")(lambda spark, sf: M.metrics_legacy(_wide(spark, sf)))

# ------------------------------------------------------------------ M4
register("kappa", with_base(f"""cm AS (SELECT model_key, prompt, {confusion_sql()} FROM cl GROUP BY model_key, prompt)""") + f"""
SELECT model_key, prompt, n_valid AS n, round({kappa_sql('TP', 'FN', 'FP', 'TN')}, 6) AS kappa FROM cm""")(
    lambda spark, sf: M.add_rates(M.confusion_table(_wide(spark, sf)), digits=6)
    .select("model_key", "prompt", F.col("n_valid").alias("n"), "kappa"))

_KA, _KB = "confidence_claude_sonnet46_promptC", "confidence_gpt55_promptC"
register("kappa_multiclass", with_base("""w AS (
  SELECT block_id, max(confidence) FILTER (WHERE cond = 'claude_sonnet46_promptC') AS a,
         max(confidence) FILTER (WHERE cond = 'gpt55_promptC') AS b FROM ann GROUP BY block_id),
pairs AS (SELECT a, b, count(*) AS c FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b),
ra AS (SELECT a, sum(c) AS ra FROM pairs GROUP BY a),
cb AS (SELECT b, sum(c) AS cb FROM pairs GROUP BY b),
tot AS (SELECT sum(c) AS n, sum(c) FILTER (WHERE a = b) AS agree FROM pairs),
pe AS (SELECT sum(CAST(ra AS DOUBLE) * CAST(cb AS DOUBLE)) AS s FROM ra JOIN cb ON ra.a = cb.b)""") + """
SELECT CAST(n AS BIGINT) AS n,
       round((CAST(n AS DOUBLE) * CAST(agree AS DOUBLE) - s) / NULLIF(CAST(n AS DOUBLE) * CAST(n AS DOUBLE) - s, 0), 6) AS kappa
FROM tot, pe""")(lambda spark, sf: M.kappa_multiclass(_wide(spark, sf), _KA, _KB))

# ------------------------------------------------------------------ M5
_CA, _CB = "DIL_claude_sonnet46_promptC", "DIL_gpt55_promptC"
_PAIR_CTE = """w AS (
  SELECT block_id, max(DIL) AS DIL,
         max(CASE label WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END) FILTER (WHERE cond = '{a}') AS a,
         max(CASE label WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END) FILTER (WHERE cond = '{b}') AS b
  FROM ann GROUP BY block_id)"""
register("compare_annotators", with_base(_PAIR_CTE.format(a="claude_sonnet46_promptC", b="gpt55_promptC")) + """
SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS total,
       count(*) FILTER (WHERE a = b) AS agreement,
       count(*) FILTER (WHERE a = 1 AND b = 1) AS both_yes,
       count(*) FILTER (WHERE a = 0 AND b = 0) AS both_no,
       count(*) FILTER (WHERE a = 1 AND b = 0) AS yes_no,
       count(*) FILTER (WHERE a = 0 AND b = 1) AS no_yes,
       round(COALESCE(CAST(count(*) FILTER (WHERE a = b) AS DOUBLE) /
             NULLIF(CAST(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS DOUBLE), 0), 0.0), 6) AS rate
FROM w""")(lambda spark, sf: M.compare_annotators(_wide(spark, sf), _CA, _CB))

# every two conditions: the pair is part of the group
def _pairs_cte(value: str) -> str:
    return f"""v AS (SELECT block_id, cond, cond_idx, {value} AS x, CASE DIL WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS g FROM ann),
pc AS (SELECT l.cond AS ca, r.cond AS cb, l.x AS a, r.x AS b, l.g AS g, count(*) AS c
       FROM v l JOIN v r ON l.block_id = r.block_id AND l.cond_idx < r.cond_idx
       WHERE l.x IS NOT NULL AND r.x IS NOT NULL GROUP BY ALL)"""


_YES_NO = "CASE label WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END"
_CONFIDENCE = ["high", "medium", "low"]


def _confidence_pairs(spark, sf):
    wide = _wide(spark, sf)
    return M.kappa_multiclass_pairs(wide, [c.replace("DIL_", "confidence_", 1) for c, _, _ in M.detect_conditions(wide)], _CONFIDENCE)


register("kappa_multiclass_pairs", with_base(_pairs_cte("confidence"), """
ra AS (SELECT ca, cb, a, sum(c) AS ra FROM pc GROUP BY ALL), rb AS (SELECT ca, cb, b, sum(c) AS rb FROM pc GROUP BY ALL),
pe AS (SELECT ca, cb, sum(CAST(ra AS DOUBLE) * CAST(rb AS DOUBLE)) AS s FROM ra JOIN rb USING (ca, cb) WHERE a = b GROUP BY ca, cb),
tot AS (SELECT ca, cb, sum(c) AS n, COALESCE(sum(c) FILTER (WHERE a = b), 0) AS agree FROM pc GROUP BY ca, cb)""") + """
SELECT 'confidence_' || ca AS "system_A", 'confidence_' || cb AS "system_B", CAST(n AS BIGINT) AS n,
       round((CAST(n AS DOUBLE) * CAST(agree AS DOUBLE) - COALESCE(s, 0)) / NULLIF(CAST(n AS DOUBLE) * CAST(n AS DOUBLE) - COALESCE(s, 0), 0), 6) AS kappa
FROM tot LEFT JOIN pe USING (ca, cb)""")(_confidence_pairs)

register("compare_annotators_pairs", with_base(_pairs_cte(_YES_NO)) + """
SELECT 'DIL_' || ca AS "system_A", 'DIL_' || cb AS "system_B", CAST(sum(c) AS BIGINT) AS total,
       CAST(COALESCE(sum(c) FILTER (WHERE a = b), 0) AS BIGINT) AS agreement,
       CAST(COALESCE(sum(c) FILTER (WHERE a = 1 AND b = 1), 0) AS BIGINT) AS both_yes,
       CAST(COALESCE(sum(c) FILTER (WHERE a = 0 AND b = 0), 0) AS BIGINT) AS both_no,
       CAST(COALESCE(sum(c) FILTER (WHERE a = 1 AND b = 0), 0) AS BIGINT) AS yes_no,
       CAST(COALESCE(sum(c) FILTER (WHERE a = 0 AND b = 1), 0) AS BIGINT) AS no_yes,
       round(CAST(COALESCE(sum(c) FILTER (WHERE a = b), 0) AS DOUBLE) / CAST(sum(c) AS DOUBLE), 6) AS rate
FROM pc GROUP BY ca, cb""")(lambda spark, sf: M.compare_annotators_pairs(_wide(spark, sf)))

register("disagreements_pairs", with_base(_pairs_cte(_YES_NO), """
dd AS (SELECT ca, cb, CASE WHEN a = 1 THEN 'yes->no' ELSE 'no->yes' END AS direction, CAST(sum(c) AS BIGINT) AS n,
              CAST(COALESCE(sum(c) FILTER (WHERE g = a), 0) AS BIGINT) AS v1_matches_gold,
              CAST(COALESCE(sum(c) FILTER (WHERE g = b), 0) AS BIGINT) AS v2_matches_gold
       FROM pc WHERE a <> b GROUP BY ca, cb, CASE WHEN a = 1 THEN 'yes->no' ELSE 'no->yes' END)""") + """
SELECT 'DIL_' || ca AS "system_A", 'DIL_' || cb AS "system_B", direction, n, v1_matches_gold, v2_matches_gold,
       round(CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY ca, cb) AS DOUBLE), 6) AS share FROM dd""")(
    lambda spark, sf: M.disagreements_pairs(_wide(spark, sf)))

# ------------------------------------------------------------------ M6 / M7
_PAIRWISE_CTE = """pw AS (
  SELECT x.model || ' / Prompt ' || x.prompt AS system_A, y.model || ' / Prompt ' || y.prompt AS system_B,
         count(*) FILTER (WHERE x.p = 1 AND y.p = 1) AS a11, count(*) FILTER (WHERE x.p = 1 AND y.p = 0) AS a10,
         count(*) FILTER (WHERE x.p = 0 AND y.p = 1) AS a01, count(*) FILTER (WHERE x.p = 0 AND y.p = 0) AS a00
  FROM cl x JOIN cl y ON x.block_id = y.block_id AND x.cond_idx < y.cond_idx
  WHERE x.p IS NOT NULL AND y.p IS NOT NULL
  GROUP BY 1, 2)"""
_PW_SELECT = f"""SELECT system_A, system_B, round({kappa_sql('a11', 'a10', 'a01', 'a00')}, 4) AS kappa,
       CAST(a11 + a10 + a01 + a00 AS BIGINT) AS n FROM pw WHERE a11 + a10 + a01 + a00 >= 10"""
register("pairwise_kappa", with_base(_PAIRWISE_CTE) + "\n" + _PW_SELECT)(
    lambda spark, sf: M.pairwise_kappa(_wide(spark, sf)))

register("kappa_band", with_base(_PAIRWISE_CTE, f"k AS ({_PW_SELECT})") + """
SELECT *, CASE WHEN kappa IS NULL THEN NULL WHEN kappa < 0 THEN 'Accordo inferiore al caso'
  WHEN kappa < 0.20 THEN 'Accordo minimo' WHEN kappa < 0.40 THEN 'Accordo debole'
  WHEN kappa < 0.60 THEN 'Accordo moderato' WHEN kappa < 0.80 THEN 'Accordo sostanziale'
  ELSE 'Accordo quasi perfetto' END AS band FROM k""")(
    lambda spark, sf: M.pairwise_kappa(_wide(spark, sf)).withColumn("band", M.kappa_band(F.col("kappa"))))

# ------------------------------------------------------------------ M8
register("label_bias", with_base() + """
SELECT model_key, prompt, count(*) AS n_valid, count(*) FILTER (WHERE p = 1) AS pred_yes,
       count(*) - count(*) FILTER (WHERE p = 1) AS pred_no, count(*) FILTER (WHERE g = 1) AS gold_yes,
       round(CAST(count(*) FILTER (WHERE p = 1) - count(*) FILTER (WHERE g = 1) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100, 6) AS bias_pct
FROM cl WHERE g IS NOT NULL AND p IS NOT NULL GROUP BY model_key, prompt""")(
    lambda spark, sf: M.label_bias(_wide(spark, sf)))

# ------------------------------------------------------------------ M9
_METRICS = ["accuracy", "precision", "recall", "f1", "specificity", "kappa"]
_MELT = " UNION ALL ".join(
    f"SELECT model_key, prompt, '{m}' AS metric, {m} AS value FROM summary" for m in _METRICS)
register("metric_delta", SUMMARY_SQL + f""", melt AS ({_MELT})
SELECT a.model_key, a.metric, a.value AS value_a, b.value AS value_b, round(a.value - b.value, 4) AS delta
FROM melt a JOIN melt b ON a.model_key = b.model_key AND a.metric = b.metric
WHERE a.prompt = 'Prompt C' AND b.prompt = 'Prompt A'""")(
    lambda spark, sf: M.metric_delta(_summary(spark, sf)))

# ------------------------------------------------------------------ M10 - M14
_LABEL_CASE = "CASE model_key " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in fx.MODEL_LABELS.items()) + " ELSE model_key END"
_RANK_MODELS = f"""rm AS (
  SELECT model_key, CAST(sum(CAST(round(kappa * 10000) AS BIGINT)) AS DOUBLE) / CAST(count(kappa) AS DOUBLE) / 10000.0 AS kappa_mean, stddev_samp(kappa) AS kappa_std, CAST(sum(CAST(round(f1 * 10000) AS BIGINT)) AS DOUBLE) / CAST(count(f1) AS DOUBLE) / 10000.0 AS f1_mean,
         CAST(sum(CAST(round(accuracy * 10000) AS BIGINT)) AS DOUBLE) / CAST(count(accuracy) AS DOUBLE) / 10000.0 AS accuracy_mean FROM summary GROUP BY model_key),
rmr AS (SELECT row_number() OVER (ORDER BY kappa_mean DESC, model_key) AS rank, model_key,
         {_LABEL_CASE} AS model_label, round(kappa_mean, 6) AS kappa_mean, round(kappa_std, 6) AS kappa_std,
         round(f1_mean, 6) AS f1_mean, round(accuracy_mean, 6) AS accuracy_mean FROM rm)"""
_RANK_PROMPTS = """rp AS (
  SELECT prompt, CAST(sum(CAST(round(kappa * 10000) AS BIGINT)) AS DOUBLE) / CAST(count(kappa) AS DOUBLE) / 10000.0 AS kappa_mean, stddev_samp(kappa) AS kappa_std, CAST(sum(CAST(round(f1 * 10000) AS BIGINT)) AS DOUBLE) / CAST(count(f1) AS DOUBLE) / 10000.0 AS f1_mean
  FROM summary GROUP BY prompt),
rpr AS (SELECT row_number() OVER (ORDER BY kappa_mean DESC, prompt) AS rank, prompt,
         round(kappa_mean, 6) AS kappa_mean, round(kappa_std, 6) AS kappa_std, round(f1_mean, 6) AS f1_mean FROM rp)"""
register("rank_models", SUMMARY_SQL + ", " + _RANK_MODELS + "\nSELECT * FROM rmr")(
    lambda spark, sf: M.rank_models(_summary(spark, sf)))
register("rank_prompts", SUMMARY_SQL + ", " + _RANK_PROMPTS + "\nSELECT * FROM rpr")(
    lambda spark, sf: M.rank_prompts(_summary(spark, sf)))
register("best_per_model", SUMMARY_SQL + """, r AS (
  SELECT *, row_number() OVER (PARTITION BY model_key ORDER BY kappa DESC NULLS LAST, prompt) AS rn FROM summary)
SELECT model, model_key, prompt, kappa, f1, accuracy FROM r WHERE rn = 1""")(
    lambda spark, sf: M.best_per_model(_summary(spark, sf)))
register("best_overall", SUMMARY_SQL + ", " + _RANK_MODELS + ", " + _RANK_PROMPTS + """
SELECT m.model_label AS best_model, round(m.kappa_mean, 4) AS best_model_kappa,
       p.prompt AS best_prompt, round(p.kappa_mean, 4) AS best_prompt_kappa
FROM rmr m, rpr p WHERE m.rank = 1 AND p.rank = 1""")(
    lambda spark, sf: M.best_overall(_summary(spark, sf)))
for _metric in ("accuracy", "kappa"):
    register(f"{_metric}_matrix", SUMMARY_SQL + f"""
SELECT model, {', '.join(f"max({_metric}) FILTER (WHERE prompt = 'Prompt {p}') AS {p}" for p in 'ABC')}
FROM summary GROUP BY model""")(lambda spark, sf, _m=_metric: M.metric_matrix(_summary(spark, sf), _m))

# ------------------------------------------------------------------ M15 / M16
_ERR = """count(*) AS n, count(*) FILTER (WHERE correct = 0) AS errors"""
_ERR_RATES = """round(CAST(errors AS DOUBLE) / CAST(n AS DOUBLE), 6) AS error_rate,
       round(1 - CAST(errors AS DOUBLE) / CAST(n AS DOUBLE), 6) AS accuracy"""
register("errors_by_author", with_base(f"""ea AS (SELECT model, prompt, author, {_ERR} FROM lf
  GROUP BY model, prompt, author HAVING count(*) >= 5),
er AS (SELECT *, {_ERR_RATES} FROM ea),
rk AS (SELECT *, row_number() OVER (PARTITION BY model, prompt ORDER BY error_rate DESC, author) AS rank FROM er)""") + """
SELECT * FROM rk WHERE rank <= 10""")(lambda spark, sf: M.errors_by_author(_lf(spark, sf, ["author"])))

register("errors_by_period", with_base(f"""ea AS (SELECT model, prompt, period, {_ERR} FROM lf
  GROUP BY model, prompt, period)""") + f"""
SELECT *, {_ERR_RATES} FROM ea""")(lambda spark, sf: M.errors_by(_lf(spark, sf), ["period"]))

# ------------------------------------------------------------------ M17
register("disagreements", with_base(_PAIR_CTE.format(a="claude_sonnet46_promptA", b="claude_sonnet46_promptC"),
                                    """d AS (SELECT CASE DIL WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS g, a, b FROM w
  WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
agg AS (SELECT CASE WHEN a = 1 THEN 'yes->no' ELSE 'no->yes' END AS direction, count(*) AS n,
         count(*) FILTER (WHERE g = a) AS v1_matches_gold, count(*) FILTER (WHERE g = b) AS v2_matches_gold
  FROM d GROUP BY 1)""") + """
SELECT *, round(CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE), 6) AS share FROM agg""")(
    lambda spark, sf: M.disagreements(_wide(spark, sf), "DIL_claude_sonnet46_promptA", "DIL_claude_sonnet46_promptC"))

# ------------------------------------------------------------------ M19
register("error_examples", with_base("""o AS (
  SELECT model, prompt, block_id, CASE WHEN gold = 0 AND pred = 1 THEN 'FP' ELSE 'FN' END AS outcome
  FROM lf WHERE pred <> gold),
r AS (SELECT *, row_number() OVER (PARTITION BY model, prompt, outcome ORDER BY block_id) AS rank FROM o)""") + """
SELECT * FROM r WHERE rank <= 10""")(
    lambda spark, sf: top_n_per_group(
        _lf(spark, sf).where(F.col("pred") != F.col("gold"))
        .select("model", "prompt", "block_id", M.outcome(F.col("gold"), F.col("pred")).alias("outcome")),
        ["model", "prompt", "outcome"], [F.col("block_id")], 10, salt_col="block_id"))

# ------------------------------------------------------------------ M20
register("coverage_rollup", with_base("""la AS (
  SELECT *, CASE WHEN year > 1820 AND year <= 1870 THEN '1830-1870' WHEN year > 1870 AND year <= 1900 THEN '1871-1900'
    WHEN year > 1900 AND year <= 1935 THEN '1901-1930' ELSE 'nan' END AS period FROM lf0)""") + """
SELECT period, decade, author, work, GROUPING(period, decade, author, work) AS level, count(*) AS n_rows,
       count(pred) AS n_valid, count(*) FILTER (WHERE pred = 1) AS n_yes,
       round(CAST(count(pred) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS coverage,
       round(CAST(count(*) FILTER (WHERE pred = 1) AS DOUBLE) / NULLIF(CAST(count(pred) AS DOUBLE), 0), 6) AS yes_rate,
       round(1 - CAST(count(pred) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS error_rate
FROM (SELECT *, CAST(floor(year / 10) * 10 AS INTEGER) AS decade FROM la) x
GROUP BY ROLLUP (period, decade, author, work)""")(
    lambda spark, sf: M.coverage_rollup(long_all(_wide(spark, sf), ["author", "work"])))

# ------------------------------------------------------------------ M21
register("metrics_by_split", with_base(f"""cm AS (
  SELECT split, model_key, any_value(model) AS model, prompt, {confusion_sql()} FROM cl GROUP BY split, model_key, prompt)""") + f"""
SELECT split, model, model_key, 'Prompt ' || prompt AS prompt, n_total, n_valid, n_error,
       {rates_sql(4)}, TP, FP, FN, TN FROM cm""")(
    lambda spark, sf: M.metrics_summary(_wide(spark, sf), by=["split"]))


# ------------------------------------------------------------------ S6 (metric CSV + nested JSON round trip)
_METRIC_STRUCT = ("struct<model:string,prompt:string,n_total:bigint,n_valid:bigint,n_error:bigint,"
                  "accuracy:double,precision:double,recall:double,f1:double,specificity:double,kappa:double,"
                  "TP:bigint,FP:bigint,FN:bigint,TN:bigint>")


def _metrics_json(spark, sf):
    import uuid
    from annospark.session import checkpoint_dir
    from annospark.sources.files import write_metrics
    path = f"{checkpoint_dir(spark).rstrip('/')}/metrics-{uuid.uuid4().hex}"
    write_metrics(_summary(spark, sf), path)
    back = spark.read.schema(f"metrics map<string,{_METRIC_STRUCT}>").json(f"{path}/json")
    return back.select(F.explode("metrics").alias("condition", "m")).select("condition", "m.*")


register("metrics_json", SUMMARY_SQL + """
SELECT model_key || '_prompt' || right(prompt, 1) AS condition, model, prompt, n_total, n_valid, n_error,
       accuracy, precision, recall, f1, specificity, kappa, TP, FP, FN, TN FROM summary""")(_metrics_json)

"""Inference and stability queries (cluster bootstrap, Holm, stability, PPV, logit)."""

from __future__ import annotations

from pyspark.sql import functions as F

from annospark.constants import (COMMERCIAL_MODELS, CONTRAST_MODEL_PAIRS, HIGHCONF_MODELS,
                                 MODEL_ORDER, PERIOD_LABELS)
from annospark.functions.hashing import sql_h_parts
from annospark.functions.stats import spearman_p
from annospark.operators import inference as I
from annospark.operators import models as MD
from annospark.operators.reshape import long_fact
from annospark.plans import fixtures as fx
from annospark.plans.catalog import register
from annospark.plans.oracle_base import kappa_sql, with_base

N_BOOT, SEED = 2000, 42


def _lf(spark, sf):
    return long_fact(fx.annotations_wide(spark, sf))


def _lst(xs):
    return ", ".join(f"'{x}'" for x in xs)


# ---- shared oracle CTEs ----------------------------------------------------
_DC = """dc AS (SELECT doc_id, model, prompt,
    count(*) FILTER (WHERE gold = 1 AND pred = 1) AS TP, count(*) FILTER (WHERE gold = 1 AND pred = 0) AS FN,
    count(*) FILTER (WHERE gold = 0 AND pred = 1) AS FP, count(*) FILTER (WHERE gold = 0 AND pred = 0) AS TN
  FROM lf GROUP BY doc_id, model, prompt)"""
_BOOT = f"""docs AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM (SELECT DISTINCT doc_id FROM lf) x),
nd AS (SELECT count(*) AS D FROM docs),
ids AS (SELECT unnest(range(0, {N_BOOT} * D)) AS id, D FROM nd),
dr AS (SELECT id // D AS b, id % D AS j, D FROM ids),
draws AS (SELECT b, {sql_h_parts(str(SEED), 'b', 'j')} % D AS k, count(*) AS mult FROM dr GROUP BY 1, 2),
rep0 AS (SELECT b, model, prompt, sum(TP * mult) AS TP, sum(FN * mult) AS FN, sum(FP * mult) AS FP, sum(TN * mult) AS TN
  FROM draws JOIN docs USING (k) JOIN dc USING (doc_id) GROUP BY b, model, prompt),
rep AS (SELECT b, model, prompt, {kappa_sql('TP', 'FN', 'FP', 'TN')} AS kappa FROM rep0),
pk0 AS (SELECT model, prompt, sum(TP) AS TP, sum(FN) AS FN, sum(FP) AS FP, sum(TN) AS TN FROM dc GROUP BY model, prompt),
pk AS (SELECT model, prompt, {kappa_sql('TP', 'FN', 'FP', 'TN')} AS kappa FROM pk0)"""

_CONTRASTS = [(f"{a} C - {b} C", a, "C", b, "C") for a, b in CONTRAST_MODEL_PAIRS]
for _m in MODEL_ORDER:
    _CONTRASTS += [(f"{_m} C - {_m} A", _m, "C", _m, "A"), (f"{_m} B - {_m} A", _m, "B", _m, "A")]
_CON = "con AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(f"'{v}'" for v in row) + ")" for row in _CONTRASTS) + ") t(contrasto, m1, p1, m2, p2))"
_CONTRAST_CTE = f"""{_CON},
d AS (SELECT con.contrasto, r1.kappa - r2.kappa AS d FROM con
  JOIN rep r1 ON r1.model = con.m1 AND r1.prompt = con.p1
  JOIN rep r2 ON r2.model = con.m2 AND r2.prompt = con.p2 AND r2.b = r1.b),
st AS (SELECT contrasto, quantile_cont(d, 0.025) AS ic_inf, quantile_cont(d, 0.975) AS ic_sup,
              avg(CAST(d <= 0 AS DOUBLE)) AS le, avg(CAST(d >= 0 AS DOUBLE)) AS ge FROM d GROUP BY contrasto),
dl AS (SELECT con.contrasto, a.kappa - b.kappa AS delta_kappa FROM con
  JOIN pk a ON a.model = con.m1 AND a.prompt = con.p1 JOIN pk b ON b.model = con.m2 AND b.prompt = con.p2),
ct AS (SELECT dl.contrasto, delta_kappa, ic_inf, ic_sup, least(1.0, 2 * least(le, ge)) AS p FROM dl JOIN st USING (contrasto)),
hj AS (SELECT *, row_number() OVER (ORDER BY p, contrasto) - 1 AS j, count(*) OVER () AS m FROM ct),
ho AS (SELECT *, max(least(1.0, CAST(m - j AS DOUBLE) * p)) OVER (ORDER BY p, contrasto ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_holm FROM hj)"""


def _replicates(spark, sf):
    return I.bootstrap_replicates(spark, _lf(spark, sf), N_BOOT, SEED)


# ------------------------------------------------------------------ I2
register("bootstrap_kappa", with_base(_DC, _BOOT) + """,
ci AS (SELECT model, prompt, quantile_cont(kappa, 0.025) AS lo, quantile_cont(kappa, 0.975) AS hi FROM rep GROUP BY model, prompt)
SELECT pk.model AS modello, pk.prompt, round(pk.kappa, 6) AS kappa, round(lo, 6) AS ic_inf, round(hi, 6) AS ic_sup
FROM pk JOIN ci USING (model, prompt)""")(
    lambda spark, sf: I.bootstrap_kappa(spark, _lf(spark, sf), N_BOOT, SEED))

_W = " + ".join(f"CAST(u >= {step} AS INTEGER)" for step in I.POISSON_STEPS)
register("bootstrap_poisson", with_base(_DC, f"""dd AS (SELECT DISTINCT doc_id FROM dc),
u AS (SELECT doc_id, b, {sql_h_parts(str(SEED), 'b', 'doc_id')} AS u FROM dd, (SELECT unnest(range({N_BOOT})) AS b) r),
w AS (SELECT doc_id, b, {_W} AS w FROM u),
rep0 AS (SELECT b, model, prompt, sum(TP * w) AS TP, sum(FN * w) AS FN, sum(FP * w) AS FP, sum(TN * w) AS TN
  FROM w JOIN dc USING (doc_id) WHERE w > 0 GROUP BY b, model, prompt),
rep AS (SELECT model, prompt, {kappa_sql('TP', 'FN', 'FP', 'TN')} AS kappa FROM rep0),
pk0 AS (SELECT model, prompt, sum(TP) AS TP, sum(FN) AS FN, sum(FP) AS FP, sum(TN) AS TN FROM dc GROUP BY model, prompt),
pk AS (SELECT model, prompt, {kappa_sql('TP', 'FN', 'FP', 'TN')} AS kappa FROM pk0),
ci AS (SELECT model, prompt, quantile_cont(kappa, 0.025) AS lo, quantile_cont(kappa, 0.975) AS hi FROM rep GROUP BY model, prompt)""") + """
SELECT pk.model AS modello, pk.prompt, round(pk.kappa, 6) AS kappa, round(lo, 6) AS ic_inf, round(hi, 6) AS ic_sup
FROM pk JOIN ci USING (model, prompt)""")(lambda spark, sf: I.bootstrap_poisson(_lf(spark, sf), N_BOOT, SEED))

# ------------------------------------------------------------------ I3 / I4
register("bootstrap_contrasts", with_base(_DC, _BOOT, _CONTRAST_CTE) + """
SELECT contrasto, round(delta_kappa, 6) AS delta_kappa, round(ic_inf, 6) AS ic_inf, round(ic_sup, 6) AS ic_sup,
       round(p, 6) AS p, round(p_holm, 6) AS p_holm FROM ho""")(
    lambda spark, sf: I.bootstrap_contrasts(spark, _lf(spark, sf), N_BOOT, SEED))

register("holm", with_base(_DC, _BOOT, _CONTRAST_CTE) + """
SELECT contrasto, round(p, 6) AS p, round(p_holm, 6) AS p_holm FROM ho""")(
    lambda spark, sf: I.bootstrap_contrasts(spark, _lf(spark, sf), N_BOOT, SEED).select("contrasto", "p", "p_holm"))

# ------------------------------------------------------------------ I7 - I9
def _stab_sql(rows_cte: str) -> str:
    f = "CAST(f AS DOUBLE)"
    cols = [f"avg(CASE WHEN gold = 1 THEN {f} END) AS recall"]
    for p in PERIOD_LABELS:
        cols += [f"1 - avg(CASE WHEN gold = 0 AND period = '{p}' THEN {f} END) AS \"sp_{p}\"",
                 f"avg(CASE WHEN gold = 1 AND period = '{p}' THEN {f} END) AS \"rec_{p}\""]
    first, last = PERIOD_LABELS[0], PERIOD_LABELS[-1]
    outs = ["round(recall, 6) AS recall"]
    for p in PERIOD_LABELS:
        outs += [f"round(\"sp_{p}\", 6) AS \"sp_{p}\"", f"round(\"rec_{p}\", 6) AS \"rec_{p}\""]
    eff = repr(1 - 0.03)
    return with_base(rows_cte, f"sa AS (SELECT rule AS regola, {', '.join(cols)} FROM rr GROUP BY rule)",
                     f"sd AS (SELECT *, \"sp_{last}\" - \"sp_{first}\" AS delta_sp FROM sa)") + f"""
SELECT regola, {', '.join(outs)}, round(delta_sp, 6) AS delta_sp,
       round((-delta_sp * {eff}) / recall * 100, 6) AS effetto_equivalente_punti FROM sd"""


_VOTES = f"""vt AS (SELECT block_id, max(gold) AS gold, max(period) AS period,
    CAST(sum(CASE WHEN model IN ({_lst(COMMERCIAL_MODELS)}) THEN pred ELSE 0 END) AS BIGINT) AS yes_commercial,
    CAST(sum(pred) AS BIGINT) AS yes_all FROM lf WHERE prompt = 'C' GROUP BY block_id)"""

register("stability", _stab_sql(
    "rr AS (SELECT model AS rule, gold, period, CAST(pred = 1 AS INTEGER) AS f FROM lf WHERE prompt = 'C')"))(
    lambda spark, sf: I.stability(I.rule_rows(_lf(spark, sf), "model")))
register("stability_highconf", _stab_sql(
    f"""rr AS (SELECT model || '{I.HIGHCONF_SUFFIX}' AS rule, gold, period, CAST(pred = 1 AND high AS INTEGER) AS f
  FROM lf WHERE prompt = 'C' AND model IN ({_lst(HIGHCONF_MODELS)}))"""))(
    lambda spark, sf: I.stability(I.rule_rows(_lf(spark, sf), "highconf")))
register("stability_votes", _stab_sql(_VOTES + f""",
rr AS (SELECT '{I.VOTE_RULES[0]}' AS rule, gold, period, CAST(yes_commercial >= 2 AS INTEGER) AS f FROM vt
  UNION ALL SELECT '{I.VOTE_RULES[1]}', gold, period, CAST(yes_commercial = 3 AS INTEGER) FROM vt
  UNION ALL SELECT '{I.VOTE_RULES[2]}', gold, period, CAST(yes_all = 5 AS INTEGER) FROM vt)"""))(
    lambda spark, sf: I.stability(I.rule_rows(_lf(spark, sf), "votes")))
register("votes", with_base(_VOTES) + """
SELECT *, yes_commercial >= 2 AS majority3, yes_commercial = 3 AS unanimity3, yes_all = 5 AS unanimity5 FROM vt""")(
    lambda spark, sf: I.votes(_lf(spark, sf)))

# ------------------------------------------------------------------ I10
register("ppv", with_base("""pa AS (SELECT model AS modello,
    avg(CASE WHEN gold = 1 THEN CAST(correct AS DOUBLE) END) AS se,
    avg(CASE WHEN gold = 0 THEN CAST(correct AS DOUBLE) END) AS sp FROM lf WHERE prompt = 'C' GROUP BY model)""") + f"""
SELECT modello, round(se, 6) AS recall, round(sp, 6) AS specificita,
  round(se * {repr(865 / 29293)} / NULLIF(se * {repr(865 / 29293)} + (1 - sp) * (1 - {repr(865 / 29293)}), 0), 6) AS ppv_prevalenza_reale,
  CAST(round_even(se * 865, 0) AS BIGINT) AS blocchi_dil_recuperati_su_865,
  CAST(round_even((1 - sp) * 28428, 0) AS BIGINT) AS segnalazioni_non_confermate FROM pa""")(
    lambda spark, sf: I.ppv(_lf(spark, sf)))

# ------------------------------------------------------------------ I12 / I13 / I14
_DOCSP = """ds AS (SELECT doc_id, any_value(year) AS year, CAST(count(*) FILTER (WHERE gold = 0) AS DOUBLE) / 5 AS nneg,
    avg(CASE WHEN gold = 0 THEN CAST(correct AS DOUBLE) END) AS sp FROM lf WHERE prompt = 'C' GROUP BY doc_id)"""
register("doc_specificity", with_base(_DOCSP) + "\nSELECT * FROM ds")(
    lambda spark, sf: I.doc_specificity(_lf(spark, sf)))
_SPEAR = [_DOCSP, """r AS (SELECT
    rank() OVER (ORDER BY year) + (count(*) OVER (PARTITION BY year) - 1) / 2.0 AS ry,
    rank() OVER (ORDER BY sp) + (count(*) OVER (PARTITION BY sp) - 1) / 2.0 AS rs FROM ds WHERE nneg >= 5)""",
          "sr AS (SELECT round(corr(ry, rs), 6) AS rho, count(*) AS romanzi FROM r)"]
register("spearman_year", with_base(*_SPEAR) + """
SELECT rho, romanzi FROM sr""")(
    lambda spark, sf: I.spearman_year(_lf(spark, sf)))
_F, _L = PERIOD_LABELS[0], PERIOD_LABELS[-1]
_LOO = [f"""pd AS (SELECT doc_id,
    sum(CASE WHEN gold = 0 AND period = '{_F}' THEN correct ELSE 0 END) AS s1, count(*) FILTER (WHERE gold = 0 AND period = '{_F}') AS n1,
    sum(CASE WHEN gold = 0 AND period = '{_L}' THEN correct ELSE 0 END) AS s2, count(*) FILTER (WHERE gold = 0 AND period = '{_L}') AS n2
  FROM lf WHERE prompt = 'C' GROUP BY doc_id)""", """x AS (SELECT
    CAST(sum(s1) OVER () - s1 AS DOUBLE) AS s1, CAST(sum(n1) OVER () - n1 AS DOUBLE) AS n1,
    CAST(sum(s2) OVER () - s2 AS DOUBLE) AS s2, CAST(sum(n2) OVER () - n2 AS DOUBLE) AS n2 FROM pd)""",
        """lo AS (SELECT round(min(s2 / NULLIF(n2, 0) - s1 / NULLIF(n1, 0)), 6) AS min_delta_sp,
       round(max(s2 / NULLIF(n2, 0) - s1 / NULLIF(n1, 0)), 6) AS max_delta_sp FROM x)"""]
register("leave_one_out", with_base(*_LOO) + """
SELECT min_delta_sp, max_delta_sp FROM lo""")(
    lambda spark, sf: I.leave_one_out(_lf(spark, sf)))

# ------------------------------------------------------------------ I5 / I6 sufficient statistics
register("clogit_stats", with_base("""bs AS (SELECT block_id, sum(correct) AS k, count(*) AS m,
    array_to_string(list_sort(list(model || '@' || prompt)), ',') AS sig FROM lf GROUP BY block_id)""") + """
SELECT sig AS signature, CAST(k AS BIGINT) AS k, count(*) AS n_blocks FROM bs WHERE k > 0 AND k < m GROUP BY sig, k""")(
    lambda spark, sf: I.clogit_stats(_lf(spark, sf), F.concat_ws("@", "model", "prompt")))
register("informative_blocks", with_base("""b AS (SELECT model, block_id, min(correct) AS lo, max(correct) AS hi
  FROM lf GROUP BY model, block_id)""") + """
SELECT model AS modello, count(*) FILTER (WHERE lo <> hi) AS blocchi_informativi FROM b GROUP BY model""")(
    lambda spark, sf: I.informative_blocks(_lf(spark, sf)))


# ------------------------------------------------------------------ I5 / I6 / I11 fits, I12 together
def _clogit_lr(spark, sf):
    rows = MD.clogit_lr_tests(_lf(spark, sf).cache())
    return spark.createDataFrame(rows, "test string, osservazioni string, chi2 double, gl int, p double")


def _odds_ratio(spark, sf):
    rows = [(m, what, *(round(x, 6) for x in numbers), n) for m, what, *numbers, n in MD.odds_ratios(_lf(spark, sf), MODEL_ORDER)]
    return spark.createDataFrame(rows, "modello string, confronto string, odds_ratio double, ic_inf double, "
                                       "ic_sup double, p double, blocchi_informativi bigint")


def _year_trend(spark, sf):
    lf = _lf(spark, sf)
    fits = MD.logit_cluster_by(spark, lf, "correct", "model", "prompt", "year", "doc_id", "gold", [0, 1])
    rows = [(f"trend_anno_{lab}", fits[g]["beta"], fits[g]["se"], fits[g]["p"])
            for lab, g in [("specificita", 0), ("recall", 1)]]
    return spark.createDataFrame(rows, "check string, beta double, se double, p double")


def _robustness(spark, sf):
    lf = _lf(spark, sf).cache()
    sp = I.spearman_year(lf).first()
    loo = I.leave_one_out(lf).first()
    rho = sp["rho"]
    rows = [("spearman_anno_specificita", "rho", rho),
            ("spearman_anno_specificita", "p", round(spearman_p(rho, int(sp["romanzi"])), 6) if rho is not None else None),
            ("spearman_anno_specificita", "romanzi", float(sp["romanzi"])),
            ("leave_one_out_delta_sp", "min", loo["min_delta_sp"]),
            ("leave_one_out_delta_sp", "max", loo["max_delta_sp"])]
    return spark.createDataFrame(rows, "check string, stat string, value double")


# Odds ratios in SQL: Newton's method on the conditional likelihood of a block's answers given their number of
# successes k. With weights 1, exp(x), exp(y) of the prompts A, B, C that the block has, the likelihood of k = 1 or 2
# successes has the elementary symmetric sum e as its denominator; pb, pc, pbc are the chances of a success at B, C, both.
NEWTON_STEPS = 12


def _newton(i: int) -> str:
    return f"""w{i} AS MATERIALIZED (SELECT op.*, x, y, a AS wa, b * exp(x) AS wb, c * exp(y) AS wc FROM op JOIN be{i} USING (model)),
e{i} AS (SELECT *, CASE k WHEN 1 THEN wa + wb + wc ELSE wa * wb + wa * wc + wb * wc END AS e FROM w{i}),
p{i} AS (SELECT *, CASE k WHEN 1 THEN wb ELSE wb * (wa + wc) END / e AS pb, CASE k WHEN 1 THEN wc ELSE wc * (wa + wb) END / e AS pc,
    CASE k WHEN 1 THEN 0 ELSE wb * wc END / e AS pbc FROM e{i}),
g{i} AS MATERIALIZED (SELECT model, any_value(x) AS x, any_value(y) AS y, sum(tb - n * pb) AS g1, sum(tc - n * pc) AS g2,
    sum(n * pb * (1 - pb)) AS h1, sum(n * pc * (1 - pc)) AS h2, sum(n * (pbc - pb * pc)) AS h3, sum(n) AS blocks FROM p{i} GROUP BY model),
be{i + 1} AS MATERIALIZED (SELECT model, x + (h2 * g1 - h3 * g2) / (h1 * h2 - h3 * h3) AS x, y + (h1 * g2 - h3 * g1) / (h1 * h2 - h3 * h3) AS y FROM g{i})"""


def _prompt_has(p: str) -> str:
    return f"CAST(max(CASE WHEN prompt = '{p}' THEN 1 ELSE 0 END) AS DOUBLE)"


_OP = f"""ob AS (SELECT model, block_id, sum(correct) AS k, count(*) AS m, {_prompt_has('A')} AS a, {_prompt_has('B')} AS b, {_prompt_has('C')} AS c,
    sum(CASE WHEN prompt = 'B' THEN correct ELSE 0 END) AS tb, sum(CASE WHEN prompt = 'C' THEN correct ELSE 0 END) AS tc
  FROM lf GROUP BY model, block_id),
op AS MATERIALIZED (SELECT model, k, a, b, c, CAST(count(*) AS DOUBLE) AS n, CAST(sum(tb) AS DOUBLE) AS tb, CAST(sum(tc) AS DOUBLE) AS tc
  FROM ob WHERE k > 0 AND k < m GROUP BY model, k, a, b, c),
be0 AS (SELECT DISTINCT model, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y FROM op)"""
# two-sided normal tail: 1 - erf(u), u = |z| / sqrt 2, erf(u) = exp(-u^2) * sum of u^(2j+1) / gamma(j + 3/2)
_ERF = "list_sum(list_transform(range(0, 400), lambda j: exp((2 * j + 1) * ln(u) - lgamma(j + 1.5) - u * u)))"
register("odds_ratio", with_base(_OP, *[_newton(i) for i in range(NEWTON_STEPS)], f"""co AS (
  SELECT model, 'B vs A' AS confronto, x AS beta, sqrt(h2 / (h1 * h2 - h3 * h3)) AS se, blocks FROM g{NEWTON_STEPS - 1}
  UNION ALL SELECT model, 'C vs A', y, sqrt(h1 / (h1 * h2 - h3 * h3)), blocks FROM g{NEWTON_STEPS - 1}),
cu AS (SELECT *, greatest(abs(beta / se) / sqrt(2.0), 1e-300) AS u FROM co)""") + f"""
SELECT model AS modello, confronto, round(exp(beta), 6) AS odds_ratio, round(exp(beta - {MD.Z975!r} * se), 6) AS ic_inf,
       round(exp(beta + {MD.Z975!r} * se), 6) AS ic_sup, round(greatest(1 - {_ERF}, 0), 6) AS p,
       CAST(blocks AS BIGINT) AS blocchi_informativi FROM cu""")(_odds_ratio)

# Student's t tail with v degrees of freedom as the finite sums in the angle atan(|t| / sqrt v), one for even and one for odd v.
_T_TAIL = ["tv AS (SELECT *, romanzi - 2 AS v, atan(abs(rho) / sqrt(1 - rho * rho)) AS angle FROM sr)",
           """tp AS (SELECT *, CASE WHEN v % 2 = 0 THEN
    sin(angle) * list_sum(list_transform(range(0, v // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(cos(angle), 2 * j)))
  ELSE 2 / pi() * (angle + sin(angle) * coalesce(list_sum(list_transform(range(0, (v - 1) // 2),
    lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow(cos(angle), 2 * j + 1))), 0)) END AS inside FROM tv)"""]
register("robustness", with_base(*_SPEAR, *_LOO, *_T_TAIL) + """
SELECT 'spearman_anno_specificita' AS "check", 'rho' AS stat, rho AS value FROM tp
UNION ALL SELECT 'spearman_anno_specificita', 'p', round(1 - inside, 6) FROM tp
UNION ALL SELECT 'spearman_anno_specificita', 'romanzi', CAST(romanzi AS DOUBLE) FROM tp
UNION ALL SELECT 'leave_one_out_delta_sp', 'min', min_delta_sp FROM lo
UNION ALL SELECT 'leave_one_out_delta_sp', 'max', max_delta_sp FROM lo""")(_robustness)

register("clogit_lr")(_clogit_lr)
register("year_trend")(_year_trend)


register("clogit_score", with_base("""pb AS (SELECT block_id, count(*) AS m, sum(correct) AS k FROM lf GROUP BY block_id HAVING sum(correct) > 0 AND sum(correct) < count(*)),
sm AS (SELECT model, prompt, m, count(*) AS n, sum(correct) AS r, sum(k) AS k, sum(k * (m - k)) AS kv FROM lf JOIN pb USING (block_id) GROUP BY model, prompt, m),
uv AS (SELECT model, prompt, sum(n) AS n_blocks, sum(CAST(r AS DOUBLE) - CAST(k AS DOUBLE) / m) AS u, sum(CAST(kv AS DOUBLE) / (m * m)) AS v FROM sm GROUP BY model, prompt)""") + """
SELECT model, prompt, CAST(n_blocks AS BIGINT) AS n_blocks, round(u, 6) AS u, round(v, 6) AS v, round(u / NULLIF(sqrt(v), 0), 6) AS z FROM uv""")(
    lambda spark, sf: I.clogit_score(_lf(spark, sf)))

"""DuckDB spelling of the fixture views (used only by the oracle SQL).

The oracle computes the long annotation table directly as blocks x a VALUES
list of the 15 conditions; the Spark side builds the wide table and unpivots
it.  Both must give the same rows.
"""

from __future__ import annotations

from annospark.constants import MODEL_LABELS
from annospark.functions.hashing import sql_h, sql_h_parts
from annospark.plans.fixtures import ACCURACY, INVALID_MOD, UPPER_MOD, conditions


def conds_values() -> str:
    rows = ", ".join(
        f"('{k}', '{MODEL_LABELS[k]}', '{p}', {ACCURACY[k][p]}, {i})"
        for i, (k, p) in enumerate(conditions()))
    return f"(VALUES {rows}) t(model_key, model, prompt, thr, cond_idx)"


WORKS = f"""works AS (
  SELECT source AS work,
         CAST(1830 + {sql_h('source')} % 100 AS INTEGER) AS year,
         'author_' || CAST({sql_h("source || '/author'")} % 8 AS VARCHAR) AS author,
         source || '-' || CAST(1830 + {sql_h('source')} % 100 AS VARCHAR) || '.txt' AS doc_id
  FROM (SELECT DISTINCT source FROM documents) s)"""

BLOCKS = f"""blocks AS (
  SELECT d.doc_id AS block_id, w.doc_id, w.author, w.work, w.year, d.text,
         CASE l.quality WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS DIL,
         CASE WHEN {sql_h_parts('d.doc_id', "'split'")} % 2 = 0 THEN 'V1' ELSE 'V2_new' END AS split,
         l.quality AS gold_q
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN works w ON w.work = d.source)"""

ANN = f"""conds AS (SELECT * FROM {conds_values()}),
ann0 AS (
  SELECT b.block_id, b.doc_id, b.author, b.work, b.year, b.DIL, b.split, b.gold_q,
         c.model_key, c.model, c.prompt, c.cond_idx,
         c.model_key || '_prompt' || c.prompt AS cond,
         {sql_h_parts('b.block_id', 'c.model_key', 'c.prompt')} AS hv,
         {sql_h_parts('b.block_id', 'c.model_key', 'c.prompt', "'conf'")} AS hc,
         COALESCE(b.gold_q, {sql_h_parts('b.block_id', "'truth'")} % 2) AS truth,
         c.thr
  FROM blocks b CROSS JOIN conds c),
ann AS (
  SELECT *,
    CASE WHEN hv % {INVALID_MOD} = 0 THEN 'error'
         WHEN hv % {UPPER_MOD} = 0 THEN upper(CASE WHEN (hv % 100 < thr) = (truth = 1) THEN 'yes' ELSE 'no' END)
         ELSE CASE WHEN (hv % 100 < thr) = (truth = 1) THEN 'yes' ELSE 'no' END END AS label,
    (['high', 'medium', 'low'])[CAST(hc % 3 + 1 AS INTEGER)] AS confidence
  FROM ann0)"""

LONG_FACT = """lf0 AS (
  SELECT block_id, doc_id, author, work, split,
         TRY_CAST(NULLIF(regexp_extract(doc_id, '[-_](\\d{4})\\.txt$', 1), '') AS INTEGER) AS year,
         model, model_key, prompt, cond, cond_idx,
         CASE WHEN lower(DIL) = 'yes' THEN 1 ELSE 0 END AS gold,
         CASE lower(label) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS pred,
         COALESCE(lower(confidence) = 'high', false) AS high
  FROM ann),
lf AS (
  SELECT *, CAST(pred = gold AS INTEGER) AS correct,
         CASE WHEN year > 1820 AND year <= 1870 THEN '1830-1870'
              WHEN year > 1870 AND year <= 1900 THEN '1871-1900'
              WHEN year > 1900 AND year <= 1935 THEN '1901-1930' ELSE 'nan' END AS period
  FROM lf0 WHERE pred IS NOT NULL)"""

# Case-sensitive binarised rows (compute-metrics semantics).
CL = """cl AS (
  SELECT *, CASE DIL WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS g,
            CASE label WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS p
  FROM ann)"""


def with_base(*ctes: str) -> str:
    return "WITH " + ",\n".join([WORKS, BLOCKS, ANN, LONG_FACT, CL, *ctes])


def kappa_sql(a11: str, a10: str, a01: str, a00: str) -> str:
    n = f"CAST(({a11}) + ({a10}) + ({a01}) + ({a00}) AS DOUBLE)"
    s = (f"(CAST(({a11}) + ({a10}) AS DOUBLE) * CAST(({a11}) + ({a01}) AS DOUBLE) + "
         f"CAST(({a01}) + ({a00}) AS DOUBLE) * CAST(({a10}) + ({a00}) AS DOUBLE))")
    return f"(({n}) * CAST(({a11}) + ({a00}) AS DOUBLE) - {s}) / NULLIF(({n}) * ({n}) - {s}, 0)"


def ratio_sql(num: str, den: str, zero: str | None) -> str:
    r = f"CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0)"
    return r if zero is None else f"COALESCE({r}, {zero})"


def confusion_sql(g: str = "g", p: str = "p") -> str:
    v = f"{g} IS NOT NULL AND {p} IS NOT NULL"
    return (f"count(*) AS n_total, count(*) FILTER (WHERE {v}) AS n_valid, "
            f"count(*) FILTER (WHERE NOT ({v})) AS n_error, "
            f"count(*) FILTER (WHERE {v} AND {g} = 1 AND {p} = 1) AS TP, "
            f"count(*) FILTER (WHERE {v} AND {g} = 0 AND {p} = 1) AS FP, "
            f"count(*) FILTER (WHERE {v} AND {g} = 1 AND {p} = 0) AS FN, "
            f"count(*) FILTER (WHERE {v} AND {g} = 0 AND {p} = 0) AS TN")


def rates_sql(digits: int | None = 4, spec_zero: str | None = None, kappa_zero: str | None = None,
              acc_den: str = "TP + FP + FN + TN", drop: tuple = ()) -> str:
    r = {
        "accuracy": ratio_sql("TP + TN", acc_den, None),
        "precision": ratio_sql("TP", "TP + FP", "0.0"),
        "recall": ratio_sql("TP", "TP + FN", "0.0"),
        "f1": ratio_sql("2 * TP", "2 * TP + FP + FN", "0.0"),
        "specificity": ratio_sql("TN", "TN + FP", spec_zero),
        "kappa": kappa_sql("TP", "FN", "FP", "TN"),
    }
    if kappa_zero is not None:
        r["kappa"] = f"COALESCE({r['kappa']}, {kappa_zero})"
    return ", ".join(f"round({e}, {digits}) AS {k}" if digits is not None else f"{e} AS {k}"
                     for k, e in r.items() if k not in drop)


RAW = f"""raw0 AS (
  SELECT block_id, model_key, prompt, confidence AS conf,
         CASE WHEN lower(label) IN ('yes', 'no') THEN lower(label) ELSE 'maybe' END AS lab,
         {sql_h_parts('block_id', 'model_key', 'prompt', "'shape'")} % 11 AS shape,
         {sql_h_parts('block_id', 'model_key', 'prompt', "'rt'")} % 50 AS rt,
         {sql_h_parts('block_id', 'model_key', 'prompt', "'tin'")} % 200 AS tin,
         {sql_h_parts('block_id', 'model_key', 'prompt', "'tout'")} % 20 AS tout
  FROM ann),
raw AS (
  SELECT 'prompt' || prompt || '_row' || CAST(block_id AS VARCHAR) AS request_id, block_id, model_key, prompt,
    CASE rt WHEN 0 THEN 'errored' WHEN 1 THEN 'expired' ELSE 'succeeded' END AS result_type,
    CASE shape
      WHEN 0 THEN '{{"label": "' || lab || '", "confidence": "' || conf || '"}}'
      WHEN 1 THEN 'Risposta: {{"label":"' || lab || '","confidence":"' || conf || '"}} fine'
      WHEN 2 THEN '<think>{{"label":"' || (CASE WHEN lab = 'yes' THEN 'no' ELSE 'yes' END) || '"}}</think>{{"label":"' || lab || '","confidence":"' || conf || '"}}'
      WHEN 3 THEN lab || ' ' || conf
      WHEN 4 THEN '{{"label":"' || lab || '"}} x {{"label":"' || (CASE WHEN lab = 'yes' THEN 'no' ELSE 'yes' END) || '"}}'
      WHEN 5 THEN '{{"label":"' || upper(lab) || ' ","confidence":"' || upper(conf) || '"}}'
      WHEN 6 THEN '{{"label":"' || lab || '"'
      WHEN 8 THEN '{{''label'':''' || lab || '''}}'
      WHEN 9 THEN '{{"dil":"' || lab || '","confidenza":"' || (CASE conf WHEN 'high' THEN 'alta' WHEN 'medium' THEN 'media' WHEN 'low' THEN 'bassa' END) || '","ragionamento":"Marcatori presenti.","marcatori":["interiezioni","puntini di sospensione"]}}'
      WHEN 10 THEN ''
    END AS raw_text,
    CASE WHEN shape IN (7, 10) THEN 'reasoning: ' || lab END AS reasoning_text,
    300 + tin AS tokens_in, 5 + tout AS tokens_out
  FROM raw0)"""

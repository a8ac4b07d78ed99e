"""Answer-normalisation queries over the raw-response fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from annospark.functions import answers as A
from annospark.operators.answers import normalize_answers, status_distribution
from annospark.operators.joins import grows
from annospark.operators.metrics import markers_by_outcome, outcome
from annospark.operators.reshape import binarize, to_long
from annospark.plans import fixtures as fx
from annospark.plans.catalog import register
from annospark.plans.oracle_base import RAW, with_base
from annospark.plans.q_text import _utrim, q
from annospark.functions.text import WS

BASE = with_base(RAW)
KEYS = ["request_id", "block_id", "model_key", "prompt"]
_K = ", ".join(KEYS)


def _raw(spark, sf):
    return fx.raw_answers(spark, sf)


# ------------------------------------------------------------------ R1
register("strip_think", BASE + f"""
SELECT {_K}, regexp_replace(raw_text, {q(A.THINK_RE)}, '', 'g') AS stripped FROM raw""")(
    lambda spark, sf: _raw(spark, sf).select(*KEYS, A.strip_think(F.col("raw_text")).alias("stripped")))

# ------------------------------------------------------------------ R2 (+R1)
_STRIPPED = f"regexp_replace(raw_text, {q(A.THINK_RE)}, '', 'g')"
_SL = f"regexp_extract({_utrim(_STRIPPED)}, {q(A.JSON_SLICE_RE)}, 0)"
PARSED_JSON = f"""pj_s AS (SELECT {_K}, result_type, {_SL} AS sl FROM raw),
pj_v AS (SELECT *, COALESCE(CASE WHEN json_valid(sl) THEN json_type(sl) = 'OBJECT' ELSE false END, false) AS okj FROM pj_s),
pj_e AS (SELECT *, CASE WHEN okj THEN lower({_utrim("json_extract_string(sl, '$.label')")}) END AS lab,
                CASE WHEN okj THEN lower({_utrim("json_extract_string(sl, '$.confidence')")}) END AS conf FROM pj_v),
pj AS (SELECT {_K}, result_type, CASE WHEN lab IN ('yes', 'no') THEN lab ELSE 'error' END AS label,
       CASE WHEN lab IN ('yes', 'no') AND conf IN ('high', 'medium', 'low') THEN conf ELSE 'unknown' END AS confidence
FROM pj_e)"""
register("parse_json_answer", BASE + ", " + PARSED_JSON + f"""
SELECT {_K}, label, confidence FROM pj""")(lambda spark, sf: normalize_answers(_raw(spark, sf), "json_think").select(*KEYS, "label", "confidence"))

# ------------------------------------------------------------------ R3
_TOKS = f"string_split_regex(lower({_utrim('raw_text')}), {q(WS + '+')})"
register("parse_plain_answer", BASE + f"""
SELECT {_K}, COALESCE(list_filter({_TOKS}, lambda t: t IN ('yes', 'no'))[1], 'error') AS label,
       COALESCE(list_filter({_TOKS}, lambda t: t IN ('high', 'medium', 'low'))[1], 'unknown') AS confidence
FROM raw""")(lambda spark, sf: normalize_answers(_raw(spark, sf), "plain").select(*KEYS, "label", "confidence"))

# ------------------------------------------------------------------ R4
_CONTAINS = f"""CASE WHEN raw_text IS NULL THEN 'ERROR' WHEN contains(upper({_utrim('raw_text')}), 'YES') THEN 'YES'
  WHEN contains(upper({_utrim('raw_text')}), 'NO') THEN 'NO' ELSE 'UNCLEAR' END"""
register("parse_contains", BASE + f"\nSELECT {_K}, {_CONTAINS} AS label FROM raw")(
    lambda spark, sf: normalize_answers(_raw(spark, sf), "contains").select(*KEYS, "label"))

# ------------------------------------------------------------------ R5
register("parse_prefix", BASE + f"""
SELECT {_K}, CASE WHEN starts_with(upper({_utrim("COALESCE(raw_text, 'None')")}), 'YES') THEN 'yes' ELSE 'no' END AS label
FROM raw""")(lambda spark, sf: normalize_answers(_raw(spark, sf), "prefix").select(*KEYS, "label"))

# ------------------------------------------------------------------ R6
_L = f"lower({_utrim('raw_text')})"
register("parse_legacy", BASE + f"""
SELECT {_K}, CASE WHEN contains({_L}, 'yes') OR contains({_L}, 'sì') OR contains({_L}, 'si') THEN 'yes' ELSE 'no' END AS label
FROM raw""")(lambda spark, sf: normalize_answers(_raw(spark, sf), "legacy").select(*KEYS, "label"))

# ------------------------------------------------------------------ R7
register("parse_structured", BASE + f""", t AS (SELECT {_K}, result_type, raw_text, {_utrim('raw_text')} AS t FROM raw),
st AS (SELECT *, CASE WHEN result_type = 'errored' THEN 'api_error' WHEN result_type = 'expired' THEN 'expired'
        WHEN COALESCE(CASE WHEN json_valid(t) THEN json_type(t) = 'OBJECT' ELSE false END, false) THEN 'ok' ELSE 'parse_error' END AS status FROM t)
SELECT {_K}, status,
  CASE WHEN status = 'ok' THEN COALESCE(json_extract_string(t, '$.dil'), 'error') END AS dil,
  CASE WHEN status = 'ok' THEN COALESCE(json_extract_string(t, '$.confidenza'), 'sconosciuta') END AS confidenza,
  CASE WHEN status = 'ok' THEN COALESCE(json_extract_string(t, '$.ragionamento'), '') END AS ragionamento,
  CASE WHEN status = 'ok' THEN array_to_string(COALESCE(CAST(json_extract(t, '$.marcatori') AS VARCHAR[]), CAST([] AS VARCHAR[])), '|') END AS marcatori,
  CASE WHEN status = 'parse_error' THEN substring(raw_text, 1, 500) END AS raw_prefix
FROM st""")(lambda spark, sf: normalize_answers(_raw(spark, sf), "structured").select(
    *KEYS, "status", "dil", "confidenza", "ragionamento", F.array_join("marcatori", "|").alias("marcatori"),
    "raw_prefix"))

# ------------------------------------------------------------------ R8
register("answer_text", BASE + f"""
SELECT {_K}, COALESCE(NULLIF({_utrim('raw_text')}, ''), reasoning_text) AS answer FROM raw""")(
    lambda spark, sf: _raw(spark, sf).select(*KEYS, A.answer_text(F.col("raw_text"), F.col("reasoning_text")).alias("answer")))

# ------------------------------------------------------------------ R9
register("binarize", with_base() + """
SELECT block_id, model_key, prompt, label,
       CASE label WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS pred_cs,
       CASE lower(label) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS pred_ci FROM ann""")(
    lambda spark, sf: to_long(fx.annotations_wide(spark, sf), ["block_id"]).select(
        "block_id", "model_key", "prompt", "label",
        binarize(F.col("label")).alias("pred_cs"), binarize(F.col("label"), casefold=True).alias("pred_ci")))

# ------------------------------------------------------------------ R10
register("status_distribution", BASE + f""", c AS (SELECT {_CONTAINS} AS status FROM raw),
a AS (SELECT status, count(*) AS n FROM c GROUP BY status)
SELECT status, n, round(CAST(n AS DOUBLE) * 100 / CAST(sum(n) OVER () AS DOUBLE), 6) AS pct FROM a""")(
    lambda spark, sf: status_distribution(normalize_answers(_raw(spark, sf), "contains")))


# ------------------------------------------------------------------ R8 (structured response items)
def _responses(spark, sf):
    """Responses with a direct text (shape 0 only) and output items: a reasoning item with a
    summary, then a text item carrying the raw answer."""
    raw = _raw(spark, sf)
    items = F.array(
        F.struct(F.lit("reasoning").alias("type"), F.lit(None).cast("string").alias("text"),
                 F.array(F.concat(F.lit("summary "), F.col("request_id"))).alias("summary")),
        F.struct(F.lit("text").alias("type"), F.col("raw_text").alias("text"),
                 F.lit(None).cast("array<string>").alias("summary")))
    direct = F.when(F.col("raw_text").startswith('{"label": '), F.col("raw_text"))
    return raw.select(*KEYS, direct.alias("direct"), items.alias("items"))


register("output_text", BASE + f"""
SELECT {_K},
  CASE WHEN starts_with(raw_text, '{{"label": ') AND {_utrim('raw_text')} <> '' THEN {_utrim('raw_text')}
       WHEN raw_text IS NOT NULL AND raw_text <> '' THEN {_utrim('raw_text')}
       ELSE 'summary ' || request_id END AS answer
FROM raw""")(lambda spark, sf: _responses(spark, sf).select(
    *KEYS, A.output_text(F.col("direct"), F.col("items")).alias("answer")))


# ------------------------------------------------------------------ S7 (reasoning log JSONL round trip)
def _reasoning_log(spark, sf):
    import uuid
    from annospark.session import checkpoint_dir
    from annospark.sources.files import read_log, write_log
    p = normalize_answers(_raw(spark, sf), "structured").where(~F.col("result_type").eqNullSafe("expired"))   # no log row
    ok = F.col("status") == "ok"
    log = p.select(
        "model_key",
        F.col("block_id").cast("int").alias("index"),
        F.when(ok, F.col("dil")).otherwise(F.col("status")).alias("decisione"),
        F.when(ok, F.col("confidenza")).alias("confidenza"),
        F.when(ok, F.col("ragionamento")).alias("ragionamento"),
        F.when(ok, F.col("marcatori")).alias("marcatori"),
        F.col("tokens_in").cast("bigint").alias("tokens_input"),
        F.col("tokens_out").cast("bigint").alias("tokens_output"),
        F.when(F.col("status") == "parse_error", F.lit("invalid JSON")).alias("errore"),
        F.col("raw_prefix").alias("risposta_grezza"),
        F.when(F.col("status") == "api_error", F.col("result_type")).alias("tipo_errore"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/reasoning-log-{uuid.uuid4().hex}"
    write_log(log, path, by="model_key")
    back = read_log(spark, path)
    return back.groupBy("model_key", "decisione").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens_input").alias("tokens_input"),
        F.sum("tokens_output").alias("tokens_output"),
        F.sum(F.coalesce(F.size("marcatori"), F.lit(0))).cast("bigint").alias("n_markers"),
        F.count("errore").alias("n_parse_errors"), F.count("tipo_errore").alias("n_api_errors"))


register("reasoning_log", BASE + f""", t AS (SELECT model_key, block_id, result_type, raw_text, tokens_in, tokens_out,
    {_utrim('raw_text')} AS t FROM raw),
st AS (SELECT *, CASE WHEN result_type = 'errored' THEN 'api_error' WHEN result_type = 'expired' THEN 'expired'
        WHEN COALESCE(CASE WHEN json_valid(t) THEN json_type(t) = 'OBJECT' ELSE false END, false) THEN 'ok'
        ELSE 'parse_error' END AS status FROM t),
lg AS (SELECT model_key, CASE WHEN status = 'ok' THEN COALESCE(json_extract_string(t, '$.dil'), 'error') ELSE status END AS decisione,
    tokens_in, tokens_out,
    CASE WHEN status = 'ok' THEN COALESCE(len(CAST(json_extract(t, '$.marcatori') AS VARCHAR[])), 0) ELSE 0 END AS nm,
    status FROM st WHERE status <> 'expired')
SELECT model_key, decisione, count(*) AS n, CAST(sum(tokens_in) AS BIGINT) AS tokens_input,
       CAST(sum(tokens_out) AS BIGINT) AS tokens_output, CAST(sum(nm) AS BIGINT) AS n_markers,
       count(*) FILTER (WHERE status = 'parse_error') AS n_parse_errors,
       count(*) FILTER (WHERE status = 'api_error') AS n_api_errors
FROM lg GROUP BY model_key, decisione""")(_reasoning_log)


# ------------------------------------------------------------------ M18 (markers named by the answers)
def _answer_markers(spark, sf):
    """Markers that valid structured answers name, by outcome of each model and prompt."""
    p = normalize_answers(_raw(spark, sf), "structured").where("status = 'ok'")
    gold = fx.blocks(spark, sf).select(F.col("block_id").alias("g_id"), binarize(F.col("DIL")).alias("gold"))
    j = (p.join(grows(gold), F.col("block_id") == F.col("g_id")).withColumn("pred", binarize(F.col("dil")))
         .where("gold is not null and pred is not null"))
    return markers_by_outcome(j.select("model_key", "prompt", outcome(F.col("gold"), F.col("pred")).alias("outcome"), F.col("marcatori").alias("markers")),
                              by=("model_key", "prompt"))


register("answer_markers_by_outcome", BASE + f""", t AS (SELECT model_key, prompt, block_id, result_type, raw_text, tokens_in, tokens_out,
    {_utrim('raw_text')} AS t FROM raw),
st AS (SELECT *, CASE WHEN result_type = 'errored' THEN 'api_error' WHEN result_type = 'expired' THEN 'expired'
        WHEN COALESCE(CASE WHEN json_valid(t) THEN json_type(t) = 'OBJECT' ELSE false END, false) THEN 'ok'
        ELSE 'parse_error' END AS status FROM t),

an AS (SELECT st.model_key, st.prompt, COALESCE(CAST(json_extract(st.t, '$.marcatori') AS VARCHAR[]), CAST([] AS VARCHAR[])) AS markers,
              CASE b.DIL WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS g, CASE json_extract_string(st.t, '$.dil') WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS p
       FROM st JOIN blocks b ON b.block_id = st.block_id WHERE st.status = 'ok'),
ao AS (SELECT model_key, prompt, markers, CASE WHEN g = 1 AND p = 1 THEN 'TP' WHEN g = 0 AND p = 1 THEN 'FP' WHEN g = 1 AND p = 0 THEN 'FN' ELSE 'TN' END AS outcome
       FROM an WHERE g IS NOT NULL AND p IS NOT NULL),
az AS (SELECT model_key, prompt, outcome, count(*) AS class_size FROM ao GROUP BY ALL),
am AS (SELECT model_key, prompt, outcome, marker, count(*) AS n FROM (SELECT model_key, prompt, outcome, unnest(markers) AS marker FROM ao) u GROUP BY ALL)
SELECT model_key, prompt, outcome, marker, n, class_size, round(CAST(n AS DOUBLE) / CAST(class_size AS DOUBLE), 6) AS share
FROM am JOIN az USING (model_key, prompt, outcome)""")(_answer_markers)

"""Annotation-job queries: scoring, attach, resume, cost, progress, rule annotator."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from annospark.functions.hashing import h_parts, sql_h_parts
from annospark.operators import annotate as AN
from annospark.operators import prep as P
from annospark.operators.answers import normalize_answers
from annospark.operators.joins import grows
from annospark.operators.resume import StoredAnnotations
from annospark.operators.metrics import condition_long, markers_by_outcome, outcome
from annospark.plans import fixtures as fx
from annospark.plans.catalog import register
from annospark.plans.q_text import SENT_CTE, SPLIT, TEXT_BLOCKS, q, text_blocks
from annospark.plans.oracle_base import RAW, with_base
from annospark.plans.q_answers import PARSED_JSON
from annospark.functions.text import safe_name
from annospark.session import checkpoint_dir
from annospark.sources.tables import table, table_spread
from annospark.streaming.annotate_stream import stream_annotate
from annospark.streaming.attach_stream import attach_stream

BASE = with_base(RAW) + ", " + PARSED_JSON
RUN_KEY = ["model_key", "request_id"]

_REQ = """req AS (SELECT 'prompt' || t.prompt || '_row' || CAST(d.doc_id AS VARCHAR) AS request_id, d.doc_id AS block_id, t.prompt, t.model_key
  FROM documents d, conds t)"""
_RES = f"""res0 AS (SELECT model_key, request_id, result_type, label, confidence FROM pj
  WHERE {sql_h_parts('request_id', "'drop'")} % 25 <> 0),
res AS (SELECT model_key, request_id, result_type, label, confidence, {sql_h_parts('request_id', "'arr'")} * 2 AS arrival FROM res0
  UNION ALL SELECT model_key, request_id, 'succeeded', CASE WHEN label = 'yes' THEN 'no' ELSE 'yes' END, 'low',
                   {sql_h_parts('request_id', "'arr2'")} * 2 + 1 FROM res0 WHERE {sql_h_parts('request_id', "'dup'")} % 20 = 0),
lst AS (SELECT model_key, request_id, arg_max(result_type, arrival) AS rt, arg_max(label, arrival) AS lab,
               arg_max(confidence, arrival) AS cf FROM res GROUP BY model_key, request_id),
att AS (SELECT req.model_key, req.request_id, req.block_id, req.prompt,
  CASE WHEN lst.request_id IS NULL THEN 'missing' WHEN rt = 'succeeded' THEN lab ELSE 'error' END AS label,
  CASE WHEN lst.request_id IS NULL THEN 'unknown' WHEN rt = 'succeeded' THEN cf ELSE 'unknown' END AS confidence
  FROM req LEFT JOIN lst ON lst.request_id = req.request_id AND lst.model_key = req.model_key)"""


def _attached(spark, sf):
    return AN.attach_results(fx.requests_for(spark, sf), fx.batch_results(spark, sf), RUN_KEY)


# ------------------------------------------------------------------ A2
register("attach_results", BASE + f", {_REQ}, {_RES}\nSELECT * FROM att")(_attached)

# ------------------------------------------------------------------ A3
register("pending_blocks", BASE + f", {_REQ}, {_RES}" + """
SELECT model_key, request_id, block_id, prompt FROM req
ANTI JOIN (SELECT model_key, request_id FROM att WHERE label IN ('yes', 'no')) a USING (model_key, request_id)""")(
    lambda spark, sf: AN.pending(fx.requests_for(spark, sf),
                                 _attached(spark, sf).where(F.col("label").isin("yes", "no")), RUN_KEY))


def _attach_stream(spark, sf):
    """The results land in files of their own, the later ones of a key in any of them."""
    return attach_stream(spark, fx.requests_for(spark, sf), fx.batch_results(spark, sf), RUN_KEY, files_per_trigger=1)


register("attach_stream", BASE + f", {_REQ}, {_RES}\nSELECT * FROM att")(_attach_stream)


# ------------------------------------------------------------------ A3 merge-back
def _merge_back(spark, sf):
    """A first run answers some requests, a second one fills what is pending, and is then replayed with other answers."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    fx.batch_results(spark, sf).write.parquet(path)      # parsed once, read by each of the three runs
    results = spark.read.parquet(path).select(*RUN_KEY, F.when((F.col("result_type") == "succeeded") & F.col("label").isin("yes", "no"),
                                                                  F.col("label")).alias("label"), "confidence", "arrival")
    early = h_parts("request_id", F.lit("run")) % 10 < 6
    stored = StoredAnnotations(spark, f"{checkpoint_dir(spark).rstrip('/')}/annotations-{uuid.uuid4().hex}", RUN_KEY)
    empty = F.lit(None).cast("string")
    stored.create(fx.requests_for(spark, sf).select(*RUN_KEY, empty.alias("label"), empty.alias("confidence")))
    stored.merge(results.where(early), 1).merge(results, 2).merge(results, 2)
    return stored.read()


register("merge_back", BASE + f""", {_REQ}, {_RES},
ok AS (SELECT model_key, request_id, label, confidence, arrival, CASE WHEN {sql_h_parts('request_id', "'run'")} % 10 < 6 THEN 1 ELSE 2 END AS run
       FROM res WHERE result_type = 'succeeded' AND label IN ('yes', 'no')),
f AS (SELECT model_key, request_id, min(run) AS run, arg_max(label, arrival) AS label, arg_max(confidence, arrival) AS confidence FROM ok GROUP BY ALL)
SELECT req.model_key, req.request_id, f.label, f.confidence, CAST(f.run AS INTEGER) AS run
FROM req LEFT JOIN f ON f.model_key = req.model_key AND f.request_id = req.request_id""")(_merge_back)


# ------------------------------------------------------------------ A4
def _pending_conditions(spark, sf):
    parsed = normalize_answers(fx.raw_answers(spark, sf), "json_think")
    works = fx.blocks(spark, sf).select("block_id", "work")
    grp = (parsed.join(grows(works), "block_id").groupBy("work", "model_key", "prompt")
           .agg(F.bool_and(F.col("label").isin("yes", "no")).alias("complete")))
    return grp.where(~F.coalesce("complete", F.lit(False))).select("work", "model_key", "prompt")


register("pending_conditions", BASE + """, g AS (SELECT b.work, pj.model_key, pj.prompt,
    bool_and(pj.label IN ('yes', 'no')) AS complete FROM pj JOIN blocks b USING (block_id)
  GROUP BY b.work, pj.model_key, pj.prompt)
SELECT work, model_key, prompt FROM g WHERE NOT complete""")(_pending_conditions)

# ------------------------------------------------------------------ A6 / A7
_LOG = "lg AS (SELECT ts, ([" + ", ".join(f"'{m}'" for m in fx.LOG_MODELS) + """])[CAST(user_id % 4 + 1 AS INTEGER)] AS model,
    CAST(100 + floor(value * 40) AS BIGINT) AS tokens_in, CAST(5 + event_id % 20 AS BIGINT) AS tokens_out,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status FROM events)"""
_PR = "pr AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', CAST({pi} AS DOUBLE), CAST({po} AS DOUBLE))" for m, (pi, po) in AN.PRICES.items()) + ") t(model, price_in, price_out))"
def _cost_rollup(spark, sf):
    """Priced for the 3-sentence blocks of the documents (cut by the boundary pattern)."""
    units = P.corpus_summary(table_spread(spark, sf, "documents"), "source").where("level = 0").agg(F.sum("n_chunks")).first()[0] or 0
    return AN.cost_rollup(fx.annotation_log(spark, sf), AN.price_table(spark), units)


register("cost_rollup", f"""WITH {_LOG}, {_PR}, {SENT_CTE},
nu AS (SELECT COALESCE(sum(CAST(ceil(len(sents) / 3.0) AS BIGINT)), 0) AS units FROM sa),
a AS (SELECT model, count(*) AS processed, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
             CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM lg GROUP BY model),
c AS (SELECT a.*, CAST(tokens_in AS DOUBLE) / 1e6 * price_in + CAST(tokens_out AS DOUBLE) / 1e6 * price_out AS cost
      FROM a LEFT JOIN pr USING (model))
SELECT model, processed, tokens_in, tokens_out, round(cost, 6) AS cost, round(cost * {AN.BATCH_DISCOUNT}, 6) AS cost_batch,
       round(cost / CAST(processed AS DOUBLE) * CAST(units AS DOUBLE), 6) AS cost_full_corpus FROM c, nu""")(_cost_rollup)


def _progress(spark, sf):
    total = table(spark, sf, "documents").count() * 3   # requests per model (scalar)
    return AN.progress(fx.annotation_log(spark, sf), total)


register("progress", f"""WITH {_LOG}, t AS (SELECT count(*) * 3 AS total FROM documents),
a AS (SELECT model, count(*) AS processed, count(*) FILTER (WHERE status = 'error') AS failed,
             CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1e6 AS elapsed_s FROM lg GROUP BY model),
b AS (SELECT a.*, t.total, CAST(processed AS DOUBLE) / NULLIF(elapsed_s, 0) AS rate,
             greatest(t.total - processed, 0) AS remaining FROM a, t)
SELECT model, processed, failed, round(elapsed_s, 6) AS elapsed_s,
       round(CAST(processed AS DOUBLE) * 100 / total, 6) AS pct, round(rate * 60, 6) AS rate_per_min,
       round(elapsed_s / NULLIF(CAST(processed AS DOUBLE), 0), 6) AS sec_per_block,
       remaining, round(CAST(remaining AS DOUBLE) / NULLIF(rate, 0), 6) AS eta_s FROM b""")(_progress)

register("progress_hourly", f"""WITH {_LOG}
SELECT model, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n,
       count(*) FILTER (WHERE status = 'error') AS failed FROM lg GROUP BY 1, 2""")(
    lambda spark, sf: AN.hourly_throughput(fx.annotation_log(spark, sf))
    .withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss")))


# ------------------------------------------------------------------ A8
def _smoke(spark, sf):
    per = fx.blocks(spark, sf).groupBy("work").agg(F.count(F.lit(1)).alias("n_blocks"))
    small = per.orderBy("n_blocks", "work").limit(1).select(F.col("work").alias("s_work"), F.col("n_blocks").alias("s_blocks"))
    rank = F.row_number().over(Window.orderBy("work")).cast("bigint")                   # over ten rows
    first = (per.orderBy("work").limit(10).withColumn("name_rank", rank)
             .join(F.broadcast(small), F.col("work") == F.col("s_work"), "left")       # one row
             .select("work", "n_blocks", "name_rank", F.col("s_work").isNotNull().alias("is_smallest")))
    later = (per.join(F.broadcast(small), F.col("work") <= F.col("s_work")).groupBy("s_work", "s_blocks")
             .agg(F.count(F.lit(1)).alias("name_rank")).where("name_rank > 10")
             .select(F.col("s_work").alias("work"), F.col("s_blocks").alias("n_blocks"), "name_rank", F.lit(True).alias("is_smallest")))
    return first.unionByName(later)


register("smoke_sample", with_base("""p AS (SELECT work, count(*) AS n_blocks FROM blocks GROUP BY work),
x AS (SELECT *, row_number() OVER (ORDER BY work) AS name_rank,
             row_number() OVER (ORDER BY n_blocks, work) = 1 AS is_smallest FROM p)""") + """
SELECT * FROM x WHERE name_rank <= 10 OR is_smallest""")(_smoke)


# ------------------------------------------------------------------ A9
def _flag_sql(rx: str) -> str:
    return f"COALESCE(regexp_matches(lower(text), {q(rx)}), false)"


_SCORE_SQL = "(0.0::DOUBLE" + "".join(
    f" + CASE WHEN {_flag_sql(rx)} THEN CAST({w} AS DOUBLE) ELSE 0.0::DOUBLE END" for _, rx, w in AN.MARKERS) + ")"
_FLAGS_SQL = ", ".join(f"CAST({_flag_sql(rx)} AS INTEGER) AS {name}" for name, rx, _ in AN.MARKERS)

def _lowered(spark, sf):
    return table_spread(spark, sf, "documents").select(F.col("doc_id").alias("block_id"), F.lower("text").alias("low"))


register("marker_flags", f"""
SELECT doc_id AS block_id, {_FLAGS_SQL}, round({_SCORE_SQL}, 6) AS score FROM documents""")(
    lambda spark, sf: _lowered(spark, sf).select(
        "block_id", *AN.marker_flags(F.col("low"), lowered=True), F.round(AN.marker_score(F.col("low"), lowered=True), 6).alias("score")))

register("rule_label", f"""WITH s AS (SELECT doc_id AS block_id, round({_SCORE_SQL}, 6) AS score FROM documents)
SELECT block_id, score, CASE WHEN score >= {AN.RULE_THRESHOLD} THEN 'yes' ELSE 'no' END AS label FROM s""")(
    lambda spark, sf: AN.rule_label(table_spread(spark, sf, "documents").withColumnRenamed("doc_id", "block_id"),
                                    keep=["block_id"]))

_LIST_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(lower(d.text), {q(rx)}) THEN '{name}' END" for name, rx, _ in AN.MARKERS) + "], lambda x: x IS NOT NULL)"


def _markers_by_outcome(spark, sf):
    cl = (condition_long(fx.annotations_wide(spark, sf))
          .where(F.col("gold").isNotNull() & F.col("pred").isNotNull())
          .select("block_id", "model_key", "prompt", outcome(F.col("gold"), F.col("pred")).alias("outcome")))
    mk = _lowered(spark, sf).select("block_id", AN.marker_list(F.col("low"), lowered=True).alias("markers"))
    return markers_by_outcome(cl.join(grows(mk), "block_id"), by=("model_key", "prompt"))


register("markers_by_outcome", with_base(f"""o AS (SELECT block_id, model_key, prompt,
    CASE WHEN g = 1 AND p = 1 THEN 'TP' WHEN g = 0 AND p = 1 THEN 'FP' WHEN g = 1 AND p = 0 THEN 'FN' ELSE 'TN' END AS outcome
  FROM cl WHERE g IS NOT NULL AND p IS NOT NULL)""",
                                         f"""om AS (SELECT o.model_key, o.prompt, o.outcome, {_LIST_SQL} AS markers FROM o JOIN documents d ON d.doc_id = o.block_id)""",
                                         """sz AS (SELECT model_key, prompt, outcome, count(*) AS class_size FROM om GROUP BY ALL)""",
                                         """mc AS (SELECT model_key, prompt, outcome, marker, count(*) AS n FROM (SELECT model_key, prompt, outcome, unnest(markers) AS marker FROM om) u GROUP BY ALL)""") + """
SELECT model_key, prompt, outcome, marker, n, class_size, round(CAST(n AS DOUBLE) / CAST(class_size AS DOUBLE), 6) AS share
FROM mc JOIN sz USING (model_key, prompt, outcome)""")(_markers_by_outcome)

# ------------------------------------------------------------------ A1
_RULE_RAW = (f"""'{{"label": "' || CASE WHEN round(s, 6) >= {AN.RULE_THRESHOLD} THEN 'yes' ELSE 'no' END ||
  '", "confidence": "' || CASE WHEN abs(s - {AN.RULE_THRESHOLD}) >= 0.2 THEN 'high' ELSE 'low' END || '"}}'""")
register("score_blocks", with_base(SPLIT, TEXT_BLOCKS, f"""s AS (SELECT block_id, text, {_SCORE_SQL} AS s FROM tb),
r AS (SELECT block_id, text, {_RULE_RAW} AS raw_text FROM s)""") + """
SELECT block_id, raw_text, 'ok' AS status, CAST(1 AS INTEGER) AS attempts, CAST(length(text) // 4 AS BIGINT) AS tokens_in,
       CAST(length(raw_text) // 4 AS BIGINT) AS tokens_out FROM r""")(
    lambda spark, sf: AN.rule_answers(text_blocks(spark, sf), keep=["block_id"]))

IN_FLIGHT = 3


def _slow_call(text):
    """A scorer that waits, and that fails on some texts."""
    import time
    time.sleep(0.0005)
    if len(text) % 50 == 7:
        raise ValueError("no answer")
    return '{"label": "yes"}' if len(text) % 2 == 0 else '{"label": "no"}'


def _score_concurrent(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("block_id"), "text")
    out = AN.score_concurrent(docs, _slow_call, keep=["block_id"], partitions=spark.sparkContext.defaultParallelism, in_flight=IN_FLIGHT)
    return out.select("block_id", "raw_text", "status", "attempts", F.col("in_flight").between(1, IN_FLIGHT).alias("within_limit"))


register("score_concurrent", """
SELECT doc_id AS block_id, CASE WHEN length(text) % 50 <> 7 THEN CASE WHEN length(text) % 2 = 0 THEN '{"label": "yes"}' ELSE '{"label": "no"}' END END AS raw_text,
       CASE WHEN length(text) % 50 = 7 THEN 'error' ELSE 'ok' END AS status, CAST(CASE WHEN length(text) % 50 = 7 THEN 3 ELSE 1 END AS INTEGER) AS attempts,
       true AS within_limit FROM documents""")(_score_concurrent)

# ------------------------------------------------------------------ A5 (streaming, rows-only check)
register("stream_annotate", f"""WITH s AS (SELECT doc_id, text, {_SCORE_SQL} AS s FROM documents)
SELECT doc_id, CASE WHEN round(s, 6) >= {AN.RULE_THRESHOLD} THEN 'yes' ELSE 'no' END AS label,
       CASE WHEN abs(s - {AN.RULE_THRESHOLD}) >= 0.2 THEN 'high' ELSE 'low' END AS confidence,
       'ok' AS status, CAST(1 AS INTEGER) AS attempts, CAST(length(text) // 4 AS BIGINT) AS tokens_in,
       CAST(length({_RULE_RAW.replace("round(s, 6)", "round(s, 6)")}) // 4 AS BIGINT) AS tokens_out FROM s""")(
    lambda spark, sf: stream_annotate(spark, table_spread(spark, sf, "documents"), "doc_id").drop("batch_id"))

# ------------------------------------------------------------------ P12
register("safe_name", f"""WITH {_LOG}
SELECT DISTINCT model, translate(model, '-.', '__') AS safe_model,
       'DIL_' || translate(model, '-.', '__') AS label_column FROM lg""")(
    lambda spark, sf: fx.annotation_log(spark, sf).select("model").distinct().select(
        "model", safe_name(F.col("model")).alias("safe_model"),
        F.concat(F.lit("DIL_"), safe_name(F.col("model"))).alias("label_column")))


def _smoke_rows(spark, sf, n=5):
    """First n blocks (by id) of the smallest work: the smoke-test input of a run."""
    from annospark.operators.reshape import top_n_per_group
    smallest = _smoke(spark, sf).where("is_smallest").select("work")          # one row
    b = fx.blocks(spark, sf).join(smallest, "work", "left_semi").select("work", "block_id", "text")
    return top_n_per_group(b, ["work"], [F.col("block_id")], n, salt_col="block_id")


register("smoke_rows", with_base("""p AS (SELECT work, count(*) AS n_blocks FROM blocks GROUP BY work),
s AS (SELECT work FROM p ORDER BY n_blocks, work LIMIT 1),
r AS (SELECT b.work, b.block_id, b.text, row_number() OVER (PARTITION BY b.work ORDER BY b.block_id) AS rank
      FROM blocks b JOIN s ON s.work = b.work)""") + """
SELECT work, block_id, text, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5""")(_smoke_rows)

"""Reshape, join, sampling and source/audit queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from annospark.functions.hashing import sql_h_parts
from annospark.functions.text import year_from_filename
from annospark.operators import reshape as R
from annospark.operators.audit import input_audit
from annospark.plans import fixtures as fx
from annospark.plans.catalog import register
from annospark.session import checkpoint_dir
from annospark.plans.oracle_base import with_base
from annospark.sources.tables import table

_CONDS = [f"{k}_prompt{p}" for k, p in fx.conditions()]
_PERIOD_CASE = """CASE WHEN year > 1820 AND year <= 1870 THEN '1830-1870' WHEN year > 1870 AND year <= 1900 THEN '1871-1900'
    WHEN year > 1900 AND year <= 1935 THEN '1901-1930' ELSE 'nan' END"""

# ------------------------------------------------------------------ J7 / I1
register("long_fact", with_base() + """
SELECT block_id, doc_id, year, model, prompt, gold, pred, high, correct, period FROM lf""")(
    lambda spark, sf: R.long_fact(fx.annotations_wide(spark, sf)))

# ------------------------------------------------------------------ J3
register("to_long", with_base() + """
SELECT block_id, model_key, prompt, label, confidence FROM ann""")(
    lambda spark, sf: R.to_long(fx.annotations_wide(spark, sf), ["block_id"]))

# ------------------------------------------------------------------ J5
register("pivot_long", with_base() + "\nSELECT block_id, " + ", ".join(
    f"avg(CAST(pred AS DOUBLE)) FILTER (WHERE cond = '{c}') AS \"{c}\"" for c in _CONDS) +
    " FROM lf GROUP BY block_id")(
    lambda spark, sf: R.pivot_long(
        R.long_fact(fx.annotations_wide(spark, sf), extra=["model_key"]), ["model_key", "prompt"], _CONDS))

# ------------------------------------------------------------------ J6
register("periods", with_base() + f"""
SELECT work, doc_id, year, {_PERIOD_CASE} AS period FROM works""")(
    lambda spark, sf: fx.works(spark, sf).select("work", "doc_id", "year", R.period(F.col("year")).alias("period")))

# ------------------------------------------------------------------ J1
_MERGE_COLS = ", ".join(
    f"max(label) FILTER (WHERE cond = '{c}') AS \"DIL_{c}\", max(confidence) FILTER (WHERE cond = '{c}') AS \"confidence_{c}\""
    for c in _CONDS)
_MERGED = with_base(f"""m AS (SELECT block_id, {_MERGE_COLS} FROM ann GROUP BY block_id)""") + """
SELECT b.block_id, b.doc_id, b.author, b.work, b.year, b.DIL, b.split, m.* EXCLUDE (block_id)
FROM blocks b LEFT JOIN m ON m.block_id = b.block_id"""
register("merge_conditions", _MERGED)(
    lambda spark, sf: R.merge_conditions([fx.condition_file(spark, sf, k, p) for k, p in fx.conditions()]))

MERGE_BUCKETS = 16


def _merge_stored(spark, sf):
    """The condition files stored in buckets, then merged without a shuffle."""
    run, base = uuid.uuid4().hex, checkpoint_dir(spark).rstrip("/")
    names = []
    for k, p in fx.conditions():
        names.append(f"condition_{k}_{p}_{run}".lower())
        R.store_condition(fx.condition_file(spark, sf, k, p), names[-1], f"{base}/{names[-1]}", buckets=MERGE_BUCKETS)
    return R.merge_stored(spark, names)


register("merge_stored", _MERGED)(_merge_stored)


def _merge_repeated(spark, sf):
    """Three files keyed by pairs of blocks, the first keys null, the second file with its sure answers only:
    repeated keys fan out, null meets null, keys without an answer keep their row."""
    key = F.when(F.col("block_id") >= 3, F.floor(F.col("block_id") / 2)).cast("bigint").alias("pair")
    a, b, c = (fx.condition_file(spark, sf, "gpt55", p) for p in "ABC")
    return R.merge_conditions([a.select(key, "block_id", "DIL_gpt55_promptA"),
                               b.where(F.col("confidence_gpt55_promptB") == "high").select(key, "DIL_gpt55_promptB"),
                               c.select(key, "DIL_gpt55_promptC")], on="pair")


register("merge_repeated", with_base("""k AS (SELECT block_id, prompt, label, confidence,
    CASE WHEN block_id >= 3 THEN block_id // 2 END AS pair FROM ann WHERE model_key = 'gpt55')""") + """
SELECT a.pair, a.block_id, a.label AS "DIL_gpt55_promptA", b.label AS "DIL_gpt55_promptB", c.label AS "DIL_gpt55_promptC"
FROM (SELECT * FROM k WHERE prompt = 'A') a
LEFT JOIN (SELECT * FROM k WHERE prompt = 'B' AND confidence = 'high') b ON b.pair IS NOT DISTINCT FROM a.pair
LEFT JOIN (SELECT * FROM k WHERE prompt = 'C') c ON c.pair IS NOT DISTINCT FROM a.pair""")(_merge_repeated)

# ------------------------------------------------------------------ J9
register("stratified_sample", with_base(f"""s AS (
  SELECT block_id, DIL, row_number() OVER (PARTITION BY DIL ORDER BY {sql_h_parts("42", "block_id")}, block_id) AS rn
  FROM blocks WHERE DIL IS NOT NULL)""") + """
SELECT block_id, DIL FROM s WHERE rn <= 100""")(
    lambda spark, sf: R.stratified_sample(
        fx.blocks(spark, sf).where(F.col("DIL").isNotNull()).select("block_id", "DIL"),
        "DIL", n=100, seed=42, id_col="block_id"))

# ------------------------------------------------------------------ J10
register("reconcile", """
WITH a AS (SELECT DISTINCT source, lang FROM documents),
b AS (SELECT DISTINCT d.source, d.lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT COALESCE(a.source, b.source) AS source, COALESCE(a.lang, b.lang) AS lang,
       CASE WHEN a.source IS NOT NULL AND b.source IS NOT NULL THEN 'both'
            WHEN a.source IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS side
FROM a FULL OUTER JOIN b ON a.source = b.source AND a.lang = b.lang""")(
    lambda spark, sf: R.reconcile(
        table(spark, sf, "documents").select("source", "lang"),
        table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_semi").select("source", "lang"),
        ["source", "lang"]))

# ------------------------------------------------------------------ S8
register("corpus_dim", with_base() + """
SELECT w.work, w.author, w.year, w.doc_id, count(*) AS n_blocks, count(b.DIL) AS n_labelled
FROM works w JOIN blocks b ON b.work = w.work GROUP BY w.work, w.author, w.year, w.doc_id""")(
    lambda spark, sf: fx.blocks(spark, sf).groupBy("work", "author", "year", "doc_id").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.count("DIL").alias("n_labelled")))

# ------------------------------------------------------------------ S9
register("input_audit", with_base() + """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS n_missing_text,
       count(*) FILTER (WHERE DIL = 'yes') AS n_yes, count(*) FILTER (WHERE DIL = 'no') AS n_no,
       count(*) FILTER (WHERE DIL IS NULL) AS n_unlabelled FROM blocks""")(
    lambda spark, sf: input_audit(fx.blocks(spark, sf), ["block_id", "doc_id", "text", "DIL"]))

# ------------------------------------------------------------------ P6
register("doc_year", with_base() + """
SELECT doc_id, replace(doc_id, '-', '_') AS doc_id_alt,
       TRY_CAST(NULLIF(regexp_extract(doc_id, '[-_](\\d{4})\\.txt$', 1), '') AS INTEGER) AS year,
       TRY_CAST(NULLIF(regexp_extract(replace(doc_id, '-', '_'), '[-_](\\d{4})\\.txt$', 1), '') AS INTEGER) AS year_alt,
       TRY_CAST(NULLIF(regexp_extract(work, '[-_](\\d{4})\\.txt$', 1), '') AS INTEGER) AS year_none
FROM works""")(
    lambda spark, sf: fx.works(spark, sf).select(
        "doc_id", F.regexp_replace("doc_id", "-", "_").alias("doc_id_alt"),
        year_from_filename(F.col("doc_id")).alias("year"),
        year_from_filename(F.regexp_replace("doc_id", "-", "_")).alias("year_alt"),
        year_from_filename(F.col("work")).alias("year_none")))


# ------------------------------------------------------------------ S2 (block CSV round trip)
def _read_blocks(spark, sf):
    """Blocks (texts with quotes, commas, newlines) written as quoted CSV and read back with the
    explicit block schema; per work and label: rows, characters and a text fingerprint."""
    import uuid
    from annospark.session import checkpoint_dir
    from annospark.sources.files import read_blocks, write_annotated
    path = f"{checkpoint_dir(spark).rstrip('/')}/blocks-csv-{uuid.uuid4().hex}"
    b = fx.blocks(spark, sf).select("author", "work", "year", F.col("block_id").cast("string").alias("doc_id"),
                                    "text", "DIL", "split")
    write_annotated(b, path, by=None)
    back = read_blocks(spark, path)
    return back.groupBy("work", "DIL").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("text")).cast("bigint").alias("n_chars"),
        F.sum(F.conv(F.substring(F.md5(F.col("text")), 1, 8), 16, 10).cast("bigint")).alias("text_hash"))


register("read_blocks", with_base() + """
SELECT work, DIL, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS n_chars,
       CAST(sum(CAST(('0x' || substr(md5(text), 1, 8)) AS BIGINT)) AS BIGINT) AS text_hash
FROM blocks GROUP BY work, DIL""")(_read_blocks)


# ------------------------------------------------------------------ S3 (folder of annotated files)
def _read_annotations(spark, sf):
    """Every condition written as an annotated CSV of one folder, read back as one long source."""
    import uuid
    from annospark.session import checkpoint_dir
    from annospark.sources.files import read_annotations, write_annotated
    folder = f"{checkpoint_dir(spark).rstrip('/')}/annotated-{uuid.uuid4().hex}"
    for k, p in fx.conditions():
        write_annotated(fx.condition_file(spark, sf, k, p), f"{folder}/{k}_prompt{p}_annotated.csv", by=None)
    return read_annotations(spark, folder).groupBy("source_file", "doc_id", "model_key", "prompt", "label", "confidence").agg(
        F.count(F.lit(1)).alias("n"))


register("read_annotations", with_base() + """
SELECT cond || '_annotated.csv' AS source_file, doc_id, model_key, prompt, label, confidence, count(*) AS n
FROM ann GROUP BY ALL""")(_read_annotations)

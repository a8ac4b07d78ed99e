"""normalize_answers: one Spark job over a raw-response table, any parser family."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annospark.functions import answers as A
from annospark.functions.text import utrim

MODES = ("json", "json_think", "plain", "contains", "prefix", "legacy", "structured")


def normalize_answers(df: DataFrame, mode: str, raw_col: str = "raw_text",
                      result_type_col: str = "result_type") -> DataFrame:
    """Add `label` / `confidence` (and `status` etc. for structured answers)."""
    raw = F.col(raw_col)
    if mode in ("json", "json_think"):
        src = A.strip_think(raw) if mode == "json_think" else raw
        # each step is a column that the next one reads, so a text is parsed once however often its parts are named
        cut = df.withColumn("__a", A.json_array(A.json_slice(src), A.ANSWER_SCHEMA)).withColumn("__o", A.only_object(F.col("__a")))
        cut = cut.withColumns({"__l": A.cleaned(F.col("__o.label")), "__c": A.cleaned(F.col("__o.confidence"))})
        return cut.select("*", *A.json_answer(F.col("__l"), F.col("__c"))).drop("__a", "__o", "__l", "__c")
    if mode == "plain":
        return df.withColumn("__p", A.parse_plain_answer(raw)).select("*", "__p.*").drop("__p")
    if mode == "contains":
        return df.withColumn("label", A.parse_contains(raw))
    if mode == "prefix":
        return df.withColumn("label", A.parse_prefix(raw))
    if mode == "legacy":
        return df.withColumn("label", A.parse_legacy(raw))
    if mode == "structured":
        cut = df.withColumn("__a", A.json_array(utrim(raw), A.STRUCTURED_SCHEMA)).withColumn("__o", A.only_object(F.col("__a")))
        cut = cut.withColumn("__s", A.structured_status(F.col("__o"), F.col(result_type_col)))
        return cut.select("*", *A.structured_answer(raw, F.col("__o"), F.col("__s"))).drop("__a", "__o", "__s")
    raise ValueError(f"unknown mode {mode!r}; expected one of {MODES}")


def status_distribution(df: DataFrame, status_col: str = "label") -> DataFrame:
    """Count and percentage per status (share of total over <= a handful of rows)."""
    agg = df.groupBy(F.col(status_col).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy())
    return agg.withColumn("pct", F.round(F.col("n").cast("double") * 100 / tot.cast("double"), 6))

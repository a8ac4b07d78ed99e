"""Input validation and label distribution on load (one aggregate pass)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def input_audit(df: DataFrame, required: list[str], label_col: str = "DIL",
                text_col: str = "text") -> DataFrame:
    """Fail fast on missing columns (schema only), then count rows, missing texts and labels."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    t, lab = F.col(text_col), F.col(label_col)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(t.isNull() | (F.trim(t) == "")).alias("n_missing_text"),
        F.count_if(lab == "yes").alias("n_yes"),
        F.count_if(lab == "no").alias("n_no"),
        F.count_if(lab.isNull()).alias("n_unlabelled"))

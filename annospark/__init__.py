"""annospark: corpus-annotation analytics on Spark DataFrames.

Sub-packages:
  sources    - readers/writers (text corpora, block CSVs, JSONL logs, test tables)
  functions  - Column-expression helpers (hashing, text, answer parsing) and
               small driver-side statistics helpers
  operators  - DataFrame operators: text prep, answer normalisation,
               annotation job, reshape, metrics, inference
  plans      - fixture views over the test tables and the query catalog
  streaming  - incremental (availableNow) annotation job
"""

from annospark.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
